"""The registered queries of the library and their SQL."""

from . import audience, boards, geography

QUERIES = audience.QUERIES | geography.QUERIES | boards.QUERIES
ORACLE = audience.ORACLE | geography.ORACLE | boards.ORACLE
