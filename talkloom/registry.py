"""All registered queries outside the corpus operators."""

from talkloom.plans import catalogue, conversations, logs, points, reduction, reports, retrieval, stored

MODULES = [retrieval, conversations, logs, catalogue, reduction, points, stored, reports]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in MODULES for name, sql in module.ORACLE_SQL.items()}
