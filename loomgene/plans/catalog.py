"""Registered queries of the analytics operators, and their SQL."""

from loomgene.plans import audits, coverage, genotypes, models, records

QUERIES = {**coverage.QUERIES, **genotypes.QUERIES, **records.QUERIES, **audits.QUERIES, **models.QUERIES}
ORACLE_SQL = {**coverage.ORACLE_SQL, **genotypes.ORACLE_SQL, **records.ORACLE_SQL, **audits.ORACLE_SQL, **models.ORACLE_SQL}
