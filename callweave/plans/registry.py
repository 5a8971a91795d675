"""Every registered query of the library: name -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from .capture import QUERIES as CAPTURE
from .delivery import QUERIES as DELIVERY
from .speakers import QUERIES as SPEAKERS

QUERIES = {**SPEAKERS, **DELIVERY, **CAPTURE}
