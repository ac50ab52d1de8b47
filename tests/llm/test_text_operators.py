"""Operators on texts against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import common, decontam, jaccard, langid, lines, packing, spans, suffix
from tidemark.llm.queries import tokenizer_path


def _bag(rows):
    return collections.Counter(tuple(r) for r in rows)


# --- suffix buckets ----------------------------------------------------------------------------------------


@pytest.mark.parametrize(("length", "gram"), [(40, 16), (90, 16), (200, 32)])
def test_suffix_against_brute_force(docs, corpus, length, gram):
    count = collections.Counter()
    for _, t in corpus:
        b = (t or "").encode()
        count.update(b[k : k + length] for k in range(len(b) - length + 1))
    want = []
    for d, t in corpus:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = True
        n_spans = int((np.diff(np.concatenate(([0], gone.astype(np.int8)))) == 1).sum())
        want.append((d, len(b), int(gone.sum()), n_spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    found = suffix.dedup_bytes(docs, length=length, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", F.col("kept")).collect()
    assert _bag((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in found) == _bag(want)


def test_suffix_of_nothing(nothing):
    assert suffix.dedup_bytes(nothing).count() == 0
    with pytest.raises(ValueError):
        suffix.dedup_bytes(nothing, length=30, gram=20)


# --- n-gram Jaccard join -----------------------------------------------------------------------------------


def _shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("percent", "often", "rounds"), [(75, 256, 8), (50, 256, 8), (75, 3, 2), (60, 4, 0)])
def test_components_against_brute_force(docs, corpus, percent, often, rounds, monkeypatch):
    monkeypatch.setattr(jaccard, "OFTEN", often)
    monkeypatch.setattr(jaccard, "ROUNDS", rounds)
    sets = [_shingles(t) for _, t in corpus]
    root = list(range(len(corpus)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = collections.defaultdict(list)
    for a, (d, _) in enumerate(corpus):
        groups[find(a)].append(d)
    want = []
    for a, (d, _) in enumerate(corpus):
        known = [x for x in groups[find(a)] if x is not None]
        want.append((d, len(sets[a]), min(known) if sets[a] and known else d))
    assert _bag(jaccard.components(docs, percent).collect()) == _bag(want)


def test_bitmaps_bound_the_overlap():
    rng = np.random.default_rng(1)
    for n in (3, 200, 5000):
        a, b = (np.unique(rng.integers(0, 3 * n, n).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        for x, y in ((a, b), (a, a), (a, b[: len(b) // 3])):
            assert len(np.intersect1d(x, y)) <= jaccard.overlap_bound(len(x), jaccard.signature(x), len(y), jaccard.signature(y))


def test_components_of_a_chain_and_of_nothing(spark, nothing):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.component for r in jaccard.connected_components(pairs).collect()}
    assert all(found[i] == 0 for i in range(1, 61)) and found[101] == 100
    assert jaccard.components(nothing).count() == 0

@pytest.mark.parametrize("own", [60, 100])
def test_texts_in_one_frame_make_no_pairs(spark, tmp_path, monkeypatch, own):
    """A family whose texts share most words, but less than the threshold: its tiles must not compare all with all."""
    frame, pair = " ".join(f"frame{k}" for k in range(240)), " ".join(f"pair{k}" for k in range(240))
    rows = [(k, f"{frame} " + " ".join(f"own{k}x{j}" for j in range(own + k % 3))) for k in range(400)]
    rows += [(1000, pair), (1001, f"{pair} more"), (1002, pair + " " + " ".join(f"own{j}" for j in range(60)))]
    path = str(tmp_path / "family.parquet")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(path)
    met = []
    tile_pairs = jaccard._tile_pairs

    def counted(mixed, percent):
        with monkeypatch.context() as m:
            m.setattr(jaccard, "_reach", lambda percent, x, y: "true")  # all that meet, before places are compared
            met.append(tile_pairs(mixed, percent).count())
        return tile_pairs(mixed, percent)

    monkeypatch.setattr(jaccard, "_tile_pairs", counted)
    found = {r.doc_id: r.component_id for r in jaccard.components(spark.read.parquet(path)).collect()}
    sets = {d: set(zip(*[t.split()[k:] for k in range(5)])) for d, t in rows}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    assert 0.5 < alike(0, 3) < 0.75 and alike(1000, 1002) >= 0.75
    assert found == {d: 1000 if d >= 1000 else d for d, _ in rows}
    assert met and met[0] <= 3 + len(rows)


# --- line filters ------------------------------------------------------------------------------------------


def _line_dedup(corpus, min_chars=20, min_docs=3):
    def key(x):
        k = x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
        return k if len(k) >= min_chars else None

    held = collections.defaultdict(set)
    for d, t in corpus:
        if d is not None:
            for x in (t or "").split("\n"):
                if key(x):
                    held[key(x)].add(d)
    over = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    out = []
    for d, t in corpus:
        rows = (t or "").split("\n")
        kept = [x for x in rows if d is None or key(x) not in over or over[key(x)] == d]
        out.append((d, len(rows), len(rows) - len(kept), "\n".join(kept)))
    return out


def test_lines_against_brute_force(docs, corpus):
    assert _bag(lines.LineIndex.build(docs).apply(docs).collect()) == _bag(_line_dedup(corpus))


def test_lines_can_be_taken_back(spark, docs, corpus, nothing):
    half = [x for x in corpus if x[0] is not None and x[0] % 2 == 0]
    first, second = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    index = lines.LineIndex.build(first)
    both = index.insert(second)
    known = [x for x in corpus if x[0] is not None]
    assert _bag(both.apply(docs.where("doc_id is not null")).collect()) == _bag(_line_dedup(known))
    back = both.delete(second.select("doc_id"))
    assert _bag(back.apply(first).collect()) == _bag(_line_dedup(half))
    again = back.insert(second).compact()
    again.broadcast_bytes = -1  # filters too large to send: they are probed shard by shard
    assert _bag(again.apply(docs).collect()) == _bag(_line_dedup(corpus))
    assert set(again._probed().select("key").distinct().collect()) >= set(again._over().select("key").collect())
    assert lines.LineIndex.build(nothing).apply(nothing).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [32 << 20, -1])
def test_line_shards_grow_and_columns_may_clash(spark, nothing, broadcast_bytes):
    texts = [(i, "\n".join(f"the common line number {k} of them" for k in range(300))) for i in range(4)]
    rows = spark.createDataFrame([(*x, "a", 2, None) for x in texts], "doc_id long, text string, keys string, n_lines int, kept string")
    empty = lines.LineIndex.build(nothing, keys_per_shard=20)
    grown = empty.insert(rows.where("doc_id < 2")).insert(rows.where("doc_id = 2"))
    assert empty.shards == 1 and grown.shards >= 8
    grown.broadcast_bytes = broadcast_bytes
    grown = grown.insert(rows.where("doc_id = 3"))
    found = {r.doc_id: r for r in grown.apply(rows, keep=("keys", "kept")).collect()}
    assert [found[i].n_dropped for i in range(4)] == [300, 300, 300, 0] and found[0]["keys"] == "a" and found[0].text == ""
    assert grown.delete(rows.where("doc_id < 2").select("doc_id")).apply(rows).where("n_dropped > 0").count() == 0


def test_cuckoo_filter():
    keys = np.random.default_rng(2).integers(0, 2**63, 5000).astype(np.uint64)
    cuckoo = lines.CuckooFilter(5000)
    assert cuckoo.insert(keys[:4000]) and cuckoo.contains(keys[:4000]).all()
    assert cuckoo.contains(keys[4000:]).mean() < 0.01
    cuckoo.delete(keys[:2000])
    again = lines.CuckooFilter(data=cuckoo.bytes())
    assert again.contains(keys[2000:4000]).all() and again.contains(keys[:2000]).mean() < 0.01
    assert not lines.CuckooFilter(8).insert(keys[:200])


# --- sentence spans ----------------------------------------------------------------------------------------


def _parts(text, part_words=8):
    """Words with their white space, cut at sentence ends and where the words of a sentence decide."""
    words = re.findall(r"[ \t\n\v\f\r]*[^ \t\n\v\f\r]+[ \t\n\v\f\r]*", text)
    bare = [w.strip(" \t\n\v\f\r") for w in words]
    data = [np.frombuffer(w.lower().encode() if w.isascii() else "".join(c.lower() if c.isascii() else c for c in w).encode(), np.uint8) for w in bare]
    h = [int(common.RollingHash(d).at(np.array([0]), np.array([len(d)]))[0]) for d in data]
    ends = [b[-1] in ".!?" or "\n" in w[w.index(b) + len(b) :] for w, b in zip(words, bare, strict=True)]
    cut = {k for k, e in enumerate(ends) if e} | {len(words) - 1}
    for k in range(len(words) - part_words + 1):
        if not any(ends[k : k + part_words - 1]):
            cut.add(max(range(k, k + part_words), key=lambda i: (-h[i], i)))
    out, at = [], 0
    for k in sorted(cut):
        if words:
            out.append("".join(words[at : k + 1]))
            at = k + 1
    return out


def _span_runs(parts, width=3, min_words=12):
    size = [len(p.split()) for p in parts]
    found = []
    for k in range(len(parts)):
        e = k + width
        while e <= len(parts) and sum(size[k:e]) < min_words:
            e += 1
        if e <= len(parts):
            found.append((k, e))
    if parts and (not found or found[-1][1] < len(parts)):
        k = max(0, len(parts) - width)
        while k and sum(size[k:]) < min_words:
            k -= 1
        found.append((k, len(parts)))
    return found


def test_spans_against_brute_force(docs, corpus):
    order = sorted(common.with_row_id(docs).select("_row", "doc_id", "text").collect())
    seen, want = set(), []
    for _, d, t in order:
        parts, gone = _parts(t or ""), set()
        assert [p for p in spans.sentences(t or "")] == parts and (not parts or "".join(parts) == t)
        for a, b in _span_runs(parts):
            run = tuple("".join(c.lower() if c.isascii() else c for c in "".join(parts[a:b])).split())
            if run in seen:
                gone |= set(range(a, b))
            seen.add(run)
        want.append((d, len(parts), len(gone), "".join(x for k, x in enumerate(parts) if k not in gone) if gone else t or ""))
    found = spans.dedup_spans(docs).select("doc_id", "n_sentences", "n_removed", "text").collect()
    assert _bag(found) == _bag(want)
    assert sum(r.n_removed > 0 for r in found) >= 8


def test_short_texts_are_compared(spark, tmp_path):
    lines = [f"w{i}\n" for i in range(80)]
    texts = ["".join(lines), "own start of it\n" + "".join(lines) + "and an own end\n", "a\nb\nc", "a\nb\nc", "a\nb\nd", "Eight words that are here in one line.\nfour words in this\no.\np.\nq.", "One. Two.", "one. two."]
    texts.append(texts[5])
    path = str(tmp_path / "rows")
    spark.createDataFrame([(*x, "clash", 1, None) for x in enumerate(texts)], "doc_id long, text string, row string, run int, found string").coalesce(1).write.parquet(path)
    found = {r.doc_id: r for r in spans.dedup_spans(spark.read.parquet(path)).collect()}
    assert [found[i].text for i in range(9)] == [texts[0], "own start of it\nand an own end\n", texts[2], "", texts[4], texts[5], texts[6], "", ""]
    assert found[1].n_removed == found[0].n_sentences


def test_any_51_shared_words_hold_a_run(spark, tmp_path):
    rng = np.random.default_rng(7)
    words = [f"v{i}" for i in range(3000)]
    some = lambda n: " ".join(rng.choice(words, n))
    texts = []
    for i in range(60):  # a passage within longer sentences, with and without an end of its own
        passage = some(51) if i % 3 else some(20) + ". " + some(31)
        texts += [f"{some(int(rng.integers(0, 40)))} {passage} {some(int(rng.integers(0, 40)))}" for _ in range(2)]
    path = str(tmp_path / "rows")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(path)
    found = {r.doc_id: r for r in spans.dedup_spans(spark.read.parquet(path)).collect()}
    assert all(found[2 * i].n_removed == 0 and found[2 * i + 1].n_removed >= 3 for i in range(60))
    for t in (*texts, "  a b. c\n\n d e f g h i j k l m n o p q r s t u v w x y z", "x " * 100):
        parts = spans.sentences(t)
        assert "".join(parts) == t and all(len(p.split()) <= 8 for p in parts)


def test_spans_of_nothing(nothing):
    assert spans.dedup_spans(nothing).count() == 0


# --- packing -----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("options", [{}, {"max_tokens": 64, "max_segments": 3}, {"max_tokens": 128, "max_loss": 50, "prompt_share": 0.5}])
def test_packing(docs, corpus, options):
    found = packing.pack_documents(docs.where("doc_id is null or doc_id <> 10"), tokenizer_path(), **options).collect()
    tokenizer = Tokenizer.from_file(tokenizer_path())
    most = options.get("max_tokens", 4096)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in found:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, t in corpus:
        if d == 10:
            continue
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= most and len(pieces) <= options.get("max_segments", 64) and sum(r.loss_tokens for r in pieces) <= options.get("max_loss", most)
    if not options:
        sizes = [sum(r.length for r in p) for p in by_sequence.values()]
        assert sum(most - s for s in sizes if s & (s - 1)) == 0


def test_tokenizer_is_that_of_the_library():
    ours, theirs = packing.WordTokenizer(tokenizer_path(), size=5), Tokenizer.from_file(tokenizer_path())
    for t in ["ΑΣ ΣΑΣ x", "İstanbul I'll don't it's 'sx ''s 12ab3 <|endoftext|> áb  c d\x1ce\tf", "Éµß Ŀ ǅ ", "é É!!.. ,a, word.!?x", "", " \n", "a b c d e f g h a b",
              "hello <|endoftext|> world", "x<|startoftext|>y<|ENDOFTEXT|>", "<| endoftext |>"]:
        assert list(ours.ids(t)) == theirs.encode(t, add_special_tokens=False).ids


def test_many_tiny_documents_need_no_padding(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text")).coalesce(1)
    found = packing.pack_documents(rows, tokenizer_path(), max_segments=4096)
    sizes = [r.n for r in found.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert sum(sizes) == 100_000 and sum(4096 - n for n in sizes if n & (n - 1)) == 0


def test_each_limit_of_packing_binds(docs):
    def packed(**options):
        found = packing.pack_documents(docs.where("text is not null").repartition(2, "doc_id"), tokenizer_path(), max_tokens=256, prompt_share=0.25, **options).collect()
        of = collections.defaultdict(list)
        for r in found:
            of[r.sequence_id].append(r)
        sizes = {k: sum(r.length for r in rows) for k, rows in of.items()}
        assert all(n & (n - 1) == 0 for n in sizes.values())  # full, or a power of two: nothing is padded
        return max(map(len, of.values())), max(sum(r.loss_tokens for r in rows) for rows in of.values()), sum(sizes.values())

    segments, loss, tokens = packed(max_segments=4, max_loss=208)
    assert segments <= 4 and loss <= 208
    free_segments, loss, same = packed(max_segments=256, max_loss=208)
    assert free_segments > 4 and loss <= 208 and same == tokens
    segments, free_loss, same = packed(max_segments=4)
    assert segments <= 4 and free_loss > 208 and same == tokens


def test_packing_of_nothing(nothing):
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


# --- language ID -------------------------------------------------------------------------------------------


def test_language_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", langid.held_out(F.col("doc_id")))
    model = langid.LanguageModel.fit(docs.where("not held_out"))
    found = model.predict(docs, keep=("doc_id", "held_out"))
    rates = {r.held_out: r.accuracy for r in langid.accuracy(found, docs).collect()}
    assert rates[True] >= 0.95 and rates[False] >= 0.95
    assert found.where("score < 0 or score > 1").count() == 0


def _buckets(text, orders, bits):
    points = [ord(c) for c in " " + " ".join(text.lower().split()) + " "]
    for n in orders:
        for at in range(len(points) - n + 1):
            g = 0
            for p in points[at : at + n]:
                g = (g + p) * 0x9E3779B1 % 2**32
                g ^= g >> 15
            yield (g + n) * 0x85EBCA6B % 2**32 >> (32 - bits)


def test_language_against_brute_force(spark, monkeypatch):
    """Counts, log probabilities and posteriors from scratch, and texts longer than a step."""
    rng = np.random.default_rng(3)
    letters = {"aa": "abcdeé ", "bb": "defghß ", "cc": "xyz日本 "}
    train = [(i, "".join(rng.choice(list(letters[k]), 80)), k) for i, k in enumerate(["aa", "bb", "cc"] * 5)]
    texts = ["".join(rng.choice(list("".join(letters.values())), int(n))) for n in rng.integers(1, 300, 40)] + ["½ ² ¾", "", " x ", "12 a", "É" * 3000]
    monkeypatch.setattr(langid, "STEP", 257)
    model = langid.LanguageModel.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), bits=9)
    counts = {k: collections.Counter() for k in letters}
    for _, t, k in train:
        counts[k].update(_buckets(t, (1, 2, 3), 9))
    logp = {k: [np.log((c[b] + 0.5) / (c.total() + 0.5 * 512)) for b in range(512)] for k, c in counts.items()}
    for t, (lang, score) in zip(texts, model.best(texts), strict=True):
        if not any(c.isalpha() for c in t):
            assert (lang, score) == ("und", 0.0)
            continue
        sums = {k: sum(logp[k][b] for b in _buckets(t, (1, 2, 3), 9)) for k in letters}
        best = max(sums, key=lambda k: sums[k])
        assert lang == best and abs(score - 1 / sum(np.exp(v - sums[best]) for v in sums.values())) < 1e-4


def test_language_edges(spark, docs, nothing):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "12 !?"), (4, "le chat"), (4, "the cat"), (None, "x" * 300_000)], "doc_id long, text string")
    train = spark.createDataFrame([(1, "le chat noir", "fr"), (2, "the black cat", "en"), (3, None, "en"), (4, "no label", None)], "doc_id long, text string, lang string")
    model = langid.LanguageModel.fit(train)
    found = [(r.doc_id, r.lang_pred) for r in model.predict(rows).collect()]
    assert found[:5] == [(1, "und"), (2, "und"), (3, "und"), (4, "fr"), (4, "en")]
    assert langid.LanguageModel.fit(nothing).predict(rows).where("lang_pred <> 'und'").count() == 0


# --- decontamination ---------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def benchmark(spark, corpus):
    texts = [(1, dict(corpus)[300]), (2, dict(corpus)[400][500:900]), (3, "One two"), (4, None), (5, "?!"), (6, "nothing of this is anywhere in the corpus at all, I say"), (7, "ONE, two")]
    return spark.createDataFrame([(i, t, "x") for i, t in texts], "item_id long, text string, lang string")


def _contamination(corpus, items, width):
    def words(t):
        return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]

    grams = collections.defaultdict(set)
    for i, t in items:
        w = words(t)
        n = min(width, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            grams[tuple(w[k : k + n])].add(str(i))
    for d, t in corpus:
        w = words(t)
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit |= set(range(k, k + n))
                    found |= grams[g]
        yield d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("set_rows", [1 << 21, 40])
@pytest.mark.parametrize("width", [10, 3])
def test_contamination_against_brute_force(docs, corpus, benchmark, set_rows, width):
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    found = decontam.report(docs, benchmark, width, set_rows)
    assert _bag(found.collect()) == _bag(_contamination(corpus, items, width))


def test_large_benchmark_with_a_shared_window(spark):
    prompt = " ".join(f"read{k}" for k in range(11))
    texts = [(i, f"{prompt} " + " ".join(f"w{(i * 7919 + k * k * 31) % 50_000}" for k in range(100))) for i in range(2000)]
    body = dict(texts)
    corpus = [(0, prompt), (1, "so " + prompt + " and on"), (2, " ".join(body[5].split()[20:45])), (3, None), (4, body[7] + " x " + body[8]), (5, "w1 w2 w3"), (6, " ".join(body[9].split()[50:59]))]
    docs, items = spark.createDataFrame(corpus, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string")
    assert decontam.benchmark_windows(items, 10).select("gram").distinct().count() > 190_000
    found = decontam.report(docs, items, set_rows=80_000)
    assert _bag(found.collect()) == _bag(_contamination(corpus, texts, 10))
    whole = {r.doc_id: r["items"] for r in decontam.contamination(docs, items).collect()}
    assert len(whole[0]) == len(whole[1]) == 2000 and whole[2] == ["5"] and whole[6] == []


def test_decontaminate(docs, benchmark, nothing):
    clean = decontam.decontaminate(docs, benchmark)
    assert clean.columns == docs.columns and 0 < clean.count() < docs.count()
    clash = docs.select("doc_id", "text", *[F.lit(k).alias(c) for k, c in enumerate(("_row", "words", "found", "hit", "items", "spans", "whole", "pieces"))])
    assert decontam.decontaminate(clash, benchmark).count() == clean.count()
    assert decontam.decontaminate(clash, benchmark, mode="spans").columns == clash.columns
    cut = decontam.decontaminate(docs, benchmark, mode="spans")
    assert cut.columns == docs.columns and cut.count() == docs.count()
    left = decontam.report(cut, benchmark.where("item_id < 3"))
    assert left.where("contaminated").count() == 0
    assert decontam.decontaminate(docs, nothing.selectExpr("doc_id as item_id", "text")).count() == docs.count()
    assert decontam.decontaminate(nothing, benchmark).count() == 0
