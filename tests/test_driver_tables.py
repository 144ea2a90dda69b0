"""Page queries without SQL on the driver's smallest tables: counts that are known of them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from slateflow.plans import driver_queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="needs the driver's tables")


def test_page_queries(spark):
    q = driver_queries.queries()
    sections = q["page_sections"](spark, SF)
    assert sections.count() == 469 and sections.select("page_id").distinct().count() == 50
    # Before the first root each page has one block without a heading.
    assert sections.where("heading = ''").groupBy("page_id").count().select(F.collect_set("count")).first()[0] == [1]
    guard = q["extraction_guard"](spark, SF)
    assert guard.count() == 50 and guard.where("suspicious or warnings <> ''").isEmpty()
    assert q["page_meta"](spark, SF).where("warning_count = 0 and warnings = ''").count() == 50
    chunks = q["page_chunks"](spark, SF)
    assert chunks.count() >= 469 and chunks.where("length(content) > 900 and size(split(content, '[.!?] ')) > 1").isEmpty()
    by_section = chunks.groupBy("source_id", "section_index").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"])).alias("all"))
    whole = sections.select(F.concat(F.lit("/pages/"), "page_id").alias("source_id"), "section_index", "text")
    assert by_section.join(whole, ["source_id", "section_index"]).where("`all` <> text").isEmpty()
