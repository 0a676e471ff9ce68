"""Queries over whole tables whose SQL covers only a part, against brute force."""

from __future__ import annotations

import re

from prosegauge.plans import registry
from prosegauge.plans.queries_text import documents


def test_leave_one_out_reads_every_document(spark, tiny):
    want = {}
    for r in documents(spark, tiny).collect():
        if m := re.search(r"\w+", r.text or ""):
            want[r.doc_id] = (m[0], len(m[0]) * len(re.findall(rf"(?<!\w){re.escape(m[0])}(?!\w)", r.text)))
    rows = registry.QUERIES["leave_one_out_all"](spark, tiny).collect()
    assert {r.doc_id: (r.word, r.n_removed) for r in rows} == want
    assert len(rows) > registry.QUERIES["leave_one_out"](spark, tiny).count()


def test_text_files_reads_every_item(spark, tiny):
    texts = [r.text or "" for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    assert [tuple(r) for r in registry.QUERIES["text_files_all"](spark, tiny).collect()] == [(len(texts), sum(map(len, texts)))] and len(texts) > 3
