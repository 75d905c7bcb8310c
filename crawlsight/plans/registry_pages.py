"""Page extraction, page rules, scores, cards and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from crawlsight.operators import extract as X
from crawlsight.operators import page_rules as R
from crawlsight.plans import oracle_pages as OP
from crawlsight.plans.catalog import register
from crawlsight.sources import given as G

c = F.col

FINDING_COLUMNS = ["page_id", "rule_id", "passed", "weight", "severity"]

for _family in R.FAMILIES:
    register(
        f"audit_{_family}", OP.security() if _family == "security_headers" else OP.family(_family)
    )(lambda spark, sf, fam=_family: R.audit(G.audit_pages(spark, sf), fam).select(*FINDING_COLUMNS))
