"""Every registered query of the package's own operators, and the SQL that gives the same rows."""

from __future__ import annotations

from . import audits, changes, exports, files, lints, models, publish, renditions, requests, scalars, shacl

_MODULES = (scalars, models, lints, shacl, changes, audits, requests, publish, exports, renditions, files)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
