"""The query catalogue: a name, the Spark query and the SQL that checks it."""

from __future__ import annotations

from . import basic, generating, models, scoring, sequences, validating

CATALOGUE: dict[str, tuple] = basic.CATALOGUE
