"""Building blocks as SQL expression text.

Every function takes SQL expressions (usually column names) and returns one, for ``F.expr``,
``selectExpr`` or any SQL statement. A redaction expression has some thousand nodes: as text it is
one call and one parse, while building it from Column objects costs seconds of gateway calls.
"""
