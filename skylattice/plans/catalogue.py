"""Named queries over the bundled tables, each with the SQL that an independent engine can run."""

from __future__ import annotations

from . import airspace, kpis, models, spatial, tracks

QUERIES = tracks.QUERIES | spatial.QUERIES | kpis.QUERIES | airspace.QUERIES | models.QUERIES
ORACLES = tracks.ORACLES | spatial.ORACLES | kpis.ORACLES | airspace.ORACLES | models.ORACLES
