"""All queries of the library and the SQL they are checked against."""

from __future__ import annotations

from lynxmark.plans import contexts, files, functions, intake, scores, serving, streams

QUERIES = {**scores.Q, **contexts.Q, **serving.Q, **functions.Q, **intake.Q, **files.Q, **streams.Q}
ORACLE_SQL = {**scores.SQL, **contexts.SQL, **serving.SQL, **functions.SQL, **intake.SQL, **files.SQL, **streams.SQL}
