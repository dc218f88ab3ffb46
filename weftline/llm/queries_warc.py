"""op1_warc_revisits and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.warc import deduplicated_archives, read_archives, spread
from weftline.session import table


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = deduplicated_archives(table(spark, sf_dir, "pages"), min_bytes=0)
    return read_archives(spread(files, spark)).select(F.col("key").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


SQL = {
    "op1_warc_revisits": """
with p as (
  select page_id, coalesce(html, '') html, sha1(coalesce(html, '')) h from pages
), d as (
  select page_id, octet_length(encode(html))::bigint payload_bytes, h,
         array_to_string(list_transform(range(0, 32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (1 + ((('0x' || substr(h, ((i // 4) * 5 + 1)::int, 5))::int >> (5 * (3 - i % 4))::int) & 31))::int, 1)), '') payload_digest,
         max(page_id) over (partition by h) top
  from p
)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end record_type,
       case when page_id <> top then top end refers_to
from d
""",
}

QUERIES = {"op1_warc_revisits": op1_warc_revisits}
