"""Conversations, vectors, archives and the pipeline."""

import base64
import collections
import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import ann, chat, warc


def test_snapshots(spark):
    turns = [("u", "hi"), ("a", "hello"), ("u", None), (None, "end")]
    rows = []
    for conv, n in ((5, 2), (6, 4), (7, 4), (8, 1)):
        rows += [(conv, k, *turns[k], f"row {conv}") for k in range(n)]
    rows += [(*r, "x") for r in [(9, 0, "u", "other"), (9, 0, "u", "other"), (9, None, "u", "first"), (None, 0, "u", "loose"), (10, 0, "unknown", "end")]]
    found = {r.conv_id: r for r in chat.collapse_and_render(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string")).collect()}
    assert set(found) == {6, 9, None, 10} and found[6].copies == 2 and found[6].n_turns == 4 and found[9].n_turns == 2
    assert found[9].rendered == "<|im_start|>u\nfirst<|im_end|>\n<|im_start|>u\nother<|im_end|>\n"
    assert found[6].rendered.endswith("<|im_start|>unknown\nend<|im_end|>\n")
    assert chat.collapse_and_render(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def _vectors(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, 24))
    x = centres[rng.integers(20, size=n)] + rng.normal(size=(n, 24)) * 0.6
    rows = [(i, [float(v) for v in p], 0) for i, p in enumerate(x.astype(np.float32))]
    rows += [(n + i, rows[7][1], 0) for i in range(60)]  # a common vector
    rows += [(9001, None, 0), (9002, [0.0] * 24, 0), (9003, [float("nan")] * 24, 0), (9004, [1.0, 2.0], 0), (9005, [None] * 24, 0), (9006, [float("inf")] * 24, 0), (3, rows[3][1], 0)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), rows[: n + 60]


def _nearest(rows, k=20):
    """(vec_id, score) of each query's nearest, by sums in the order of the components."""
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64)
    out = {}
    for q in np.flatnonzero(ids % 20 == 0):
        score = np.cumsum(x * x[q], axis=1)[:, -1]
        score[ids == ids[q]] = -np.inf
        out[int(ids[q])] = [(int(ids[j]), float(score[j])) for j in np.lexsort((ids, -score))[:k]]
    return out


@pytest.mark.parametrize("n", [300, 4000, 12_000])
def test_search_recall(spark, n):
    df, rows = _vectors(spark, n)
    found = collections.defaultdict(dict)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20, block=500).collect():
        found[r.query_id][r.rank] = (r.vec_id, r.score)
    want, hits = _nearest(rows), 0
    assert set(found) == set(want)
    for q, near in want.items():
        mine = [found[q][k] for k in sorted(found[q])]
        assert sorted(found[q]) == list(range(1, len(mine) + 1)) and mine == sorted(mine, key=lambda x: (-x[1], x[0]))
        hits += len(set(mine) & set(near))  # scores to the last bit
    assert hits / (20 * len(want)) >= 0.9


def test_search_ties_go_to_smaller_ids(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(40, 7))
    rows = [(100 * j + i, [float(v) for v in x[i]]) for j in range(30) for i in range(40)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string").repartition(5)
    got = collections.defaultdict(list)
    for r in ann.search(df, df.where("vec_id % 20 = 0"), k=20, block=64).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, near in got.items():
        p = x[[i for i in range(40) if q % 100 == i][0]]
        score = {i: float(np.cumsum(x[i] * p)[-1]) for i in range(40)}
        want = sorted((v for v, _ in rows if v != q), key=lambda v: (-score[v % 100], v))[:20]
        assert near[:1] == want[:1] and [score[v % 100] for v in near] == sorted((score[v % 100] for v in near), reverse=True)
        assert near == want or len(set(near) & set(want)) >= 15


def test_search_edges(spark):
    df, _ = _vectors(spark, 30)
    few = df.where("vec_id < 3")
    assert ann.search(few, few, k=20).groupBy("query_id").count().where("count <> 2").count() == 0
    assert ann.search(df.limit(0), df.limit(0)).count() == 0
    assert ann.search(df, df.where("vec_id > 9000")).count() == 0
    two = spark.createDataFrame([(i, [1.0 * i] * (2 + i % 2)) for i in range(1, 40)], "vec_id long, embedding array<double>")
    found = ann.search(two, two.where("vec_id in (3, 4)"), k=2).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(3, 39), (3, 37), (4, 38), (4, 36)]


def test_archive_round_trip(spark, tmp_path):
    pages = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u4", ""), (5, "u5", "é" * 1000), (None, "u6", "same"), (2, "u2", "same"), (7, "a\r\nb", "x" * 200_001), (8, "u" * 70_000, "WARC-Type: revisit\r\n\r\nbody")]
    df = spark.createDataFrame([(*p, "extra") for p in pages], "page_id long, url string, html string, record string")
    archive = warc.write_archive(df, chunk_bytes=512)
    assert archive.where("chunk > 0").agg(F.max(F.octet_length("data"))).first()[0] <= 512
    found = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in warc.read_archive(archive).collect())
    want = collections.Counter()
    for p, _, html in pages:
        same = [q for q, _, h in pages if (h or "") == (html or "") and q is not None]
        keeper = max(same) if same else None
        payload = (html or "").encode()
        revisit = keeper is not None and p != keeper
        want[(p, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None, True)] += 1
    assert found == want
    plain = warc.read_archive(warc.write_archive(df, min_bytes=10)).where("payload_bytes < 10 and record_type = 'revisit'")
    assert plain.count() == 0
    (tmp_path / "out").mkdir()
    files = warc.write_files(archive, str(tmp_path / "out")).collect()
    assert sum(r.records for r in files) == len(pages)
    body = b"".join((tmp_path / "out" / r.path.rsplit("/", 1)[1]).read_bytes() for r in files)
    assert body.count(b"WARC/1.1\r\n") == len(pages) and ("é" * 1000).encode() in body
    assert warc.read_archive(warc.write_archive(df.limit(0))).count() == 0
    again = warc.read_archive(warc.read_files(spark, str(tmp_path / "out"), chunk_bytes=700))
    assert collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.intact) for r in again.collect()) == want
    assert {r.url for r in again.where("page_id in (3, 7)").collect()} == {"about:blank", "a%0D%0Ab"}


def test_files_are_valid_records(spark, tmp_path):
    """Files read by a parser of their own: each record as the format wants it, HTTP responses as http.client reads them."""
    import email.parser
    import gzip
    import http.client
    import io
    import re

    pages = [(k, f"http://h/{k}?é", ("x" * k, None, "same\r\n\r\nbody")[k % 3]) for k in range(40)] + [(1, "http://h/1", ""), (None, "", "no id")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    archive = warc.write_archive(df, chunk_bytes=8, date="2024-05-06T07:08:09Z")
    (tmp_path / "w").mkdir()
    files = warc.write_files(archive, str(tmp_path / "w")).collect()
    ids, refers, bodies = [], [], collections.Counter()
    for f in files:
        data = (tmp_path / "w" / f.path.rsplit("/", 1)[1]).read_bytes()
        while data:
            head, _, data = data.partition(b"\r\n\r\n")
            version, _, rest = head.decode().partition("\r\n")
            fields = email.parser.HeaderParser().parsestr(rest)
            n = int(fields["Content-Length"])
            block, end, data = data[:n], data[n : n + 4], data[n + 4 :]
            assert version == "WARC/1.1" and end == b"\r\n\r\n" and fields["WARC-Date"] == "2024-05-06T07:08:09Z" and fields["WARC-Target-URI"]
            assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", fields["WARC-Record-ID"]) and fields["Content-Type"] == "application/http; msgtype=response"
            ids.append(fields["WARC-Record-ID"])
            if fields["WARC-Type"] == "revisit":
                refers.append(fields["WARC-Refers-To"])
                assert block.endswith(b"\r\n\r\n")
                continue

            class Wire:
                def makefile(self, *_, block=block):
                    return io.BytesIO(block)

            answer = http.client.HTTPResponse(Wire())
            answer.begin()
            body = answer.read()
            assert answer.status == 200 and fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(body).digest()).decode()
            bodies[body.decode()] += 1
    assert len(ids) == len(set(ids)) == len(pages) and refers and set(refers) <= set(ids)
    assert bodies == collections.Counter({h or "" for _, _, h in pages})
    foreign = b"WARC/1.0\r\nwarc-type: warcinfo\r\nContent-Length: 5\r\n\r\nabcde\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: http://o/\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    (tmp_path / "o").mkdir()
    (tmp_path / "o" / "a.warc.gz").write_bytes(gzip.compress(foreign[:70]) + gzip.compress(foreign[70:]))
    got = {(r.record_type, r.url, r.payload_bytes, r.page_id, r.intact) for r in warc.read_archive(warc.read_files(spark, str(tmp_path / "o"))).collect()}
    assert got == {("warcinfo", None, 5, None, None), ("response", "http://o/", 4, None, None)}
    for cut, message in ((50, "no end or no length"), (54, "ends within a record")):
        (tmp_path / "o" / "b.warc").write_bytes(foreign[:cut])
        with pytest.raises(Exception, match=message):
            warc.read_files(spark, str(tmp_path / "o")).count()


def test_pipeline(spark, sf_dir):
    import corpus_pipeline
    from tidemark.llm import decontam, jaccard, lines
    from tidemark.llm.common import table, written

    docs = table(spark, sf_dir, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = written(stage(spark, docs, sf_dir), name)
        assert after.columns == columns and 0 < after.count() <= docs.count()
        if name == "language_id":
            assert after.count() == docs.count()
        elif name == "line_dedup":
            kept = lines.LineIndex.build(docs).apply(docs).where("n_dropped < n_lines")
            assert after.select("doc_id", "text").exceptAll(kept.select("doc_id", "text")).count() == 0 and after.count() == kept.count()
        elif name == "near_duplicates":
            assert jaccard.components(docs).where("component_id = doc_id").count() == after.count()
            assert jaccard.components(after).where("component_id <> doc_id").count() == 0
        else:
            assert decontam.contamination(after, table(spark, sf_dir, "benchmark")).where("n_hit > 0").count() == 0
        docs = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    whole = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).where("n <> t")
    assert whole.count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf_dir).count() == 0


def test_near_duplicates_keep_one_row_of_each_group(spark, tmp_path):
    import corpus_pipeline

    one, two, three, four = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(None, one), (1, two), (1, two), (2, three), (2, four), (5, three), (None, two), (None, "e f"), (None, "e f"), (None, None), (9, ""), (9, "")]
    path = str(tmp_path / "rows.parquet")
    spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(path)
    docs = spark.read.parquet(path)
    found = corpus_pipeline.near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    want = [(None, one), (1, two), (2, three), (2, four), (None, "e f"), (None, None), (9, ""), (9, "")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in found.collect()))) == sorted(map(str, want))
