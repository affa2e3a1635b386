from __future__ import annotations

import hashlib
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from shelfmark.llm import queries, warc
from shelfmark.session import run_folder
from tests.compare import connect, differences
from tests.llm.rows import AWKWARD, docs_of, empty_of

SF = "/root/testdata/sf0.001"
PAGES = "page_id bigint, url string, html string, value string, file string, start string"
BODY = "<html>" + "body " * 40 + "</html>"
FAKE = (
    "text\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Page-ID: 666\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    "WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 999999\r\n\r\nx WARC/1.1\r\n" + "more " * 30
)
ROWS = [
    (1, "https://a/1", BODY), (2, "https://a/2", BODY), (3, None, None), (4, "https://a/4\r\nWARC-Type: x", ""),
    (5, "https://a/5", "short"), (6, "https://a/6", "short"), (7, "https://a/é", FAKE), (8, "https://a/8", FAKE),
    (9, "u", "WARC/1.1\r\n"), (10, "u", "\r\n\r\n"), (11, "u", "é\U0001f600\n" * 60), (12, "u", "x" * 300_000),
    (13, "u", "WARC/1.1\r\n" * 40), (None, "u", BODY), (14, "u", "a\x00b" * 50), (15, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 12),
]


def pages_of(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "v", "f", "s") for r in rows], PAGES)


def brute(rows):
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        same = [r[0] for r in rows if (r[2] or "").encode() == data and r[0] is not None]
        first = min(same, default=None)
        revisit = len(data) >= 100 and first is not None and page_id != first
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


FIELDS = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def test_archives_come_back_as_written(spark):
    found = warc.archived(pages_of(spark))
    assert sorted((tuple(r) for r in found.select(*FIELDS).collect()), key=str) == brute(ROWS)


@pytest.mark.parametrize("split", ["1k", "64k"])
def test_any_split_of_the_files_gives_the_same_records(spark, split):
    folder = run_folder(spark, "warc-test")
    rows = [(i, f"https://a/{i}", f"{i} " + (FAKE if i % 9 == 0 else "text " * (i % 70))) for i in range(200)]
    warc.write_archives(pages_of(spark, rows).coalesce(2), folder, records_a_file=60)
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split)
        found = warc.read_archives(spark, folder)
        assert sorted((tuple(r) for r in found.select(*FIELDS).collect()), key=str) == brute(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)


def test_files_are_plain_warc(spark, tmp_path):
    warc.write_archives(pages_of(spark, ROWS[:2]).coalesce(1), str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    at, kinds = 0, []
    while at < len(data):
        head, _, rest = data[at:].partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert head.startswith(b"WARC/1.1\r\n")
        size = int(fields[b"Content-Length"])
        assert rest[size:size + 4] == b"\r\n\r\n"
        kinds.append(fields[b"WARC-Type"])
        at += len(head) + 4 + size + 4
    assert sorted(kinds) == [b"response", b"revisit"]


def test_repeated_rows_and_empty_tables(spark):
    rows = [(1, "u", BODY), (1, "u", BODY), (2, "u", BODY)]
    found = warc.archived(pages_of(spark, rows)).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in found) == [(1, "response", None), (1, "response", None), (2, "revisit", 1)]
    assert warc.archived(pages_of(spark).filter("false")).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), connect(SF), queries.ORACLES[name]) == []


def test_pipeline_stages(spark, tmp_path):
    """Each stage against plain code on its own input."""
    import corpus_pipeline
    from tests.llm.test_dedup import brute_exact, brute_links, norm
    from shelfmark.llm import mixing

    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(
        docs_of(spark, [r for r in AWKWARD if r[0] is None or r[0] in (3, 4, 11)], clashes=False)
    )
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        out = str(tmp_path / name)
        mixed = {r.doc_id for r in mixing.mixed(docs).filter("sampled").collect()} if name == "source_mixing" else None
        stage(spark, docs, SF).write.parquet(out)
        docs = spark.read.parquet(out)
        if name == "language_id":
            assert {r.doc_id for r in docs.collect()} == {r[0] for r in before if any(c.isalpha() for c in r[columns.index("text")] or "")}
        elif name == "exact_dedup":
            kept = Counter((r[0], r[4]) for r in brute_exact([(r[0], r[columns.index("text")]) for r in before]) if r[3])
            assert kept == Counter((r.doc_id, hashlib.sha256(norm(r.text).encode()).hexdigest()) for r in docs.collect())
        elif name == "jaccard_join":
            assert {r.doc_id for r in docs.collect()} == {c for _, c, _ in brute_links([(r[0], r[columns.index("text")]) for r in before])}
        elif name == "source_mixing":
            assert {r.doc_id for r in docs.collect()} == mixed
        else:
            assert docs.filter("size(ids) <> n_tokens").count() == 0 and docs.count() == len(before)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    empty_of(spark.read.parquet(f"{SF}/documents.parquet")).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_entry_imports_without_the_subpackage():
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.split('.')[:2] == ['shelfmark', 'llm'] or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "del sys.modules['corpus_pipeline']; sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e; assert 'page_results' in e.queries() and not any(n.startswith('op1_') for n in e.queries())"
    )
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[2])
