"""Analytics over file-system catalogs on Spark DataFrames."""

from arborlake.catalog import Catalog
from arborlake.operators.filters import Filters
from arborlake.runtime import build_session

__all__ = ["Catalog", "Filters", "build_session"]
