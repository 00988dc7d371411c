"""The corpus operators against brute force, exact round trips and held-out accuracy, on small inputs and on odd ones."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

import corpus_pipeline
from waygrid.llm import bpe, components, decontamination, exact_dedup, files, html_text, language_id, line_dedup, near_dedup, queries, token_counts, toxicity, warc
from waygrid.llm.common import new_path, stage_table

ODD = [(1, "Same text", "a", 1), (2, "same TEXT", "b", 2), (3, None, None, 3), (4, "", "c", 4), (None, "same text", "d", 5), (2, "same TEXT", "b", 2), (7, "É x", "e", 6), (8, "é x", "f", 7), (9, "a" * 200_000, "g", 8)]
SCHEMA = "doc_id long, text string, keep_id string, bands long"  # extra columns whose names clash


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def classes(ids, linked):
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_exact(odd, none, docs):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()), key=str)
    assert got == sorted([(1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 2, 4, False), (3, 4, 2, False), (4, 4, 2, True), (7, 7, 1, True), (8, 8, 1, True), (9, 9, 1, True)], key=str)
    assert exact_dedup.exact_groups(none).count() == 0
    left = exact_dedup.drop_exact_copies(odd)
    assert left.columns == odd.columns and sorted(r.doc_id for r in left.collect()) == [2, 2, 4, 7, 8, 9]
    by = {}
    for r in docs.collect():
        by.setdefault("".join(c.lower() if c.isascii() else c for c in r.text or ""), []).append(r.doc_id)
    want = {i: (max(ids), len(ids), hashlib.sha256(t.encode()).hexdigest()) for t, ids in by.items() for i in ids}
    assert {r.doc_id: (r.keep_id, r.group_size, r.text_sha256) for r in exact_dedup.exact_groups(docs, capacity=20).collect()} == want


def test_directory_splits_overfull_buckets(spark):
    h = spark.range(5000).select(F.xxhash64("id").alias("h"))
    cells, depth = exact_dedup.directory(h, capacity=100)
    bucket = {r.cell: r for r in cells.collect()}
    n = {}
    for r in h.collect():
        n[bucket[(r.h % 2**64) >> (64 - depth)].bucket] = n.get(bucket[(r.h % 2**64) >> (64 - depth)].bucket, 0) + 1
    assert max(n.values()) <= 100 and len(n) >= 50


def brute_hits(docs, items, n=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    windows = {}
    for i, t in items:
        w = words(t)
        for k in range(max(len(w) - n, 0) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add(str(i))
    out = {}
    for i, t in docs:
        w, hit, own = words(t), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if found := windows.get(tuple(w[k : k + size])):
                    hit.update(range(k, k + size))
                    own |= found
        out[i] = (len(w), len(hit), len(own), decontamination.digest(list(own)), bool(hit))
    return out


def test_decontamination(spark, docs, sf, odd, none):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = bench.unionAll(spark.createDataFrame([(900, "same text"), (901, None), (902, "!?"), (903, "x")], bench.schema))
    for d, block in ((docs, 10**6), (docs, 50), (odd.where("doc_id <> 2 and doc_id is not null"), 10**6), (none, 50)):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontamination.contamination(d, extra, block_windows=block).collect()}
        assert got == brute_hits([(r.doc_id, r.text) for r in d.collect()], [tuple(r) for r in extra.collect()])
    dirty = spark.createDataFrame([(1, "Well, SAME text! ok same  text.", 3), (2, "clean", 4)], "doc_id long, text string, n_words int")
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(dirty, extra).collect()}
    assert cut == {1: "Well, ! ok .", 2: "clean"}
    assert [r.doc_id for r in decontamination.find_hits(dirty, extra, drop=True).collect()] == [2]
    assert not any(r.contaminated for r in decontamination.contamination(docs, bench.limit(0)).collect())


def test_near(spark, docs, odd, none):
    rows = docs.collect()
    base = " ".join(f"w{i}" for i in range(120))
    more = [(10_000 + k, base.replace(f"w{k * 7} ", f"z{k} ")) for k in range(12)] + [(20_000, "alpha beta"), (20_001, "alpha beta"), (20_002, "alpha gamma"), (20_003, None), (20_004, "")]
    d = docs.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    texts = {r.doc_id: r.text for r in rows} | dict(more)
    sets = {i: near_dedup.weighted_shingles(t or "") for i, t in texts.items()}
    ids = sorted(texts)
    linked = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near_dedup.probability_jaccard(*sets[a], *sets[b]) >= 0.8]
    got = {r.doc_id: r.class_id for r in near_dedup.near_classes(d).collect()}
    assert got == classes(ids, linked) and len(linked) > 20
    kept = near_dedup.drop_near_copies(d).collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))
    assert near_dedup.near_classes(odd).count() == len(ODD) and near_dedup.near_classes(none).count() == 0
    assert near_dedup.drop_near_copies(odd).columns == odd.columns


def test_probability_jaccard_and_its_estimate():
    rng = np.random.default_rng(1)
    h = np.sort(rng.integers(1, 2**63, 400).astype(np.uint64))
    a, b = (h[:350], rng.integers(1, 5, 350).astype(float)), (h[50:], rng.integers(1, 5, 350).astype(float))
    wa, wb = dict(zip(*a, strict=True)), dict(zip(*b, strict=True))
    exact = sum(1 / sum(max(wa.get(y, 0) / wa[x], wb.get(y, 0) / wb[x]) for y in {*wa, *wb}) for x in wa if x in wb)
    assert abs(near_dedup.probability_jaccard(*a, *b) - exact) < 1e-9
    m = 4096
    z = near_dedup.prob_min_hash(np.repeat([0, 1], 350), np.concatenate([a[0], b[0]]), np.concatenate([a[1], b[1]]), 2, m)
    assert abs((z[0] == z[1]).mean() - exact) < 5 * (exact * (1 - exact) / m) ** 0.5


def test_lines(spark, docs, odd, none):
    d = docs.where("doc_id < 40").select("doc_id", "text").unionAll(spark.createDataFrame([(500, "The quick brown fox jumps over the lazy dog today\n\nx"), (501, "the quick  brown fox jumps over the lazy dogs today\nX\nunique line here"), (502, None), (503, "")], "doc_id long, text string"))
    lines, sets = {}, {}
    for r in d.collect():
        for k, x in enumerate((r.text or "").split("\n")):
            if n := line_dedup.normalised(x):
                lines[(r.doc_id, k)] = n
                sets.setdefault(n, set(line_dedup.shingle_set(n)[0].tolist()))
    distinct = sorted(sets)
    near = [(a, b) for k, a in enumerate(distinct) for b in distinct[k + 1 :] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    cls = classes(distinct, near)
    first = {}
    for at in sorted(lines):
        first.setdefault(cls[lines[at]], at)
    want = {at: first[cls[n]] for at, n in lines.items()}
    got = {(r.doc_id, r.line_no): (r.first_doc, r.first_line) for r in line_dedup.line_classes(d).collect()}
    assert got == want and near
    dropped = {r.doc_id: r.dropped for r in line_dedup.document_lines(d).collect()}
    assert dropped[501] == [0, 1] and dropped[502] == [] and len(dropped) == d.count()
    text = {r.doc_id: r.text for r in line_dedup.drop_lines(d).collect()}
    assert text[501] == "unique line here" and text[502] is None and text[503] == ""
    assert line_dedup.document_lines(odd).count() == len(ODD) and line_dedup.document_lines(none).count() == 0


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)] + [(5, 5)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for a, b in edges if a != b for x in (a, b)})
    assert got == classes(nodes, [e for e in edges if e[0] != e[1]])


def test_language(spark, odd, none):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language_id.fit(d)
    assert set(model) == {"de", "en", "es", "fr"} and all(len(x) <= language_id.DICT_BYTES for x in model.values())
    rows = language_id.identify(d, model).where("crc32(cast(doc_id as string)) % 5 = 0").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(1, None), (2, "123 !"), (3, "the thing that was with the ounting"), (4, "")], "doc_id long, text string"), model).collect()}
    assert [got[k].lang_pred for k in (1, 2, 4)] == ["und"] * 3 and got[1].rejected and got[3].lang_pred == "en"
    assert language_id.fit(none, lang_col="keep_id") == {} and {r.lang_pred for r in language_id.identify(odd, {}).collect()} == {"und"}
    assert language_id.identify(odd, model, drop=True).columns == odd.columns


def test_toxicity(spark, odd):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ing", "ou", "re", "ti"]) for _ in range(rng.randint(1, 4)))
    text = lambda bad: ". ".join(" ".join([*(word() for _ in range(8)), *([rng.choice(["grumbo", "flakwit", "zoddle"])] if bad and rng.random() < 0.6 else [])]) for _ in range(6)) + (" grumbo" if bad else "")
    rows = [(k, text(k % 4 == 0), int(k % 4 == 0)) for k in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(d.select("doc_id", "text"), d.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(d, model).collect()}
    held = [k for k, _, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert len(held) > 50 and all(got[k].predicted == got[k].toxic for k in held)
    s = toxicity.Scorer(model).many(["", "you f.l.a.k.w.i.t", "such a g r u m b o here", "flakxwit", "their thing"])
    assert s[0] < 0.5 and min(s[1:4]) >= 0.5 and s[4] < 0.5
    assert all(0 <= r.score <= 1 for r in toxicity.score(odd, model).collect())
    assert toxicity.train([], []).probability(-1.0) < 0.5


def reference_encoding():
    c = bpe.codec(bpe.rank_file(), queries.bpe.public_tokenizers.PATTERN)
    return c, tiktoken.Encoding("own", pat_str=queries.bpe.public_tokenizers.PATTERN, mergeable_ranks=c.ranks, special_tokens={})


def test_bpe_equals_the_library(docs, odd, spark):
    c, enc = reference_encoding()
    rng = random.Random(2)
    texts = ["", "a" * 5000, "ab" * 700 + "c", " " * 300 + "x", "\U0001f600é\u0000ß" * 40, "<|endoftext|>"] + ["".join(rng.choice("abeéth 19.,\n\t'sß") for _ in range(rng.randrange(300))) for _ in range(60)]
    for t in texts + [r.text for r in docs.collect()]:
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t) and c.decode(ids) == t.encode()
    back = bpe.decode(bpe.encode(odd)).collect()
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in back) and len(back) == len(ODD)
    got = {r.doc_id: r for r in bpe.round_trip(docs).collect()}
    for r in docs.collect():
        ids = enc.encode_ordinary(r.text)
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def test_token_counts(spark, docs, odd, none):
    c, _ = reference_encoding()
    assert {r.doc_id: r.n_tokens for r in token_counts.document_token_counts(docs).collect()} == {r.doc_id: len(c.encode(r.text)) for r in docs.collect()}
    assert token_counts.document_token_counts(odd).count() == len(ODD) and token_counts.document_token_counts(none).count() == 0
    rng = np.random.default_rng(4)
    ids = rng.integers(0, 50, 3000)
    ids[rng.random(3000) < 0.01] = 99
    ids[:2] = 99
    ids[-1] = 7
    name = new_path(spark, "flat") + "/a.bin"
    with files.create(name) as f:
        f.write(ids.astype("<u4").tobytes())
    parts = np.split(ids, np.flatnonzero(ids == 99) + 1)
    want = [len(p) - (p[-1] == 99) for p in parts if len(p)]
    for block in (4, 28, 1000, 1 << 20):
        got = token_counts.count_tokens(spark.createDataFrame([(name, 12_000)], "file string, bytes long"), 99, "<u4", block).collect()
        assert [r.n_tokens for r in sorted(got, key=lambda r: r.ordinal)] == want and [r.ordinal for r in sorted(got, key=lambda r: r.ordinal)] == list(range(len(want)))


def test_warc(spark, sf):
    rows = [(1, "http://a/ b", "same"), (2, "u", "same"), (3, None, None), (4, "v", ""), (5, "w", "é" * 100_000), (None, "x", "same"), (1, "http://a/ b", "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive_round_trip(pages).collect()), key=str)
    assert got == sorted([(1, 4, "response", None), (1, 4, "response", None), (2, 4, "revisit", 1), (None, 4, "revisit", 1), (3, 0, "response", None), (4, 0, "revisit", 3), (5, 200_000, "response", None)], key=str)
    assert warc.archive_round_trip(pages.limit(0)).count() == 0
    named = spark.createDataFrame([("None", "u", "x", 1), (None, "u", "y", 2), ("", "u", "z", 3), ("a >/é+%", "u", "w", 4)], "page_id string, url string, html string, digest int")
    assert sorted((r.page_id or "", r.page_id is None) for r in warc.archive_round_trip(named).collect()) == [("", False), ("", True), ("None", False), ("a >/é+%", False)]
    assert all(r.record_type == "response" for r in warc.archive_round_trip(pages, min_bytes=10**6).collect())
    real = spark.read.parquet(f"{sf}/pages.parquet")
    archives = stage_table(warc.write_archives(warc.with_revisits(real), new_path(spark, "t")), "t")
    index = stage_table(warc.normalise(archives, new_path(spark, "t")), "t")
    side = [tuple(x.split("\t")) for f in {r.file for r in index.collect()} for x in files.open_input(f + ".idx").read().decode().splitlines()]
    assert sorted(side) == sorted((str(r.offset), str(r.length), r.record_type, r.record_id) for r in index.collect())
    back = {r.record_id: bytes(r.payload).decode() for r in warc.read_records(index).collect() if r.record_type == "response"}
    assert back == {f"<urn:page:{r.page_id}>": r.html for r in real.collect() if f"<urn:page:{r.page_id}>" in back} and len(back) >= 40
    with pytest.raises(ValueError):
        list(warc.records(iter([b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"])))
    with pytest.raises(ValueError):
        list(warc.inflate(iter([b"\x1f\x8b\x08\x00"])))


ARTICLE = "<p>" + "Long text of the article goes on and on. " * 6 + "</p>"
TEXT = ("Long text of the article goes on and on. " * 6).strip()


@pytest.mark.parametrize(("html", "text"), [
    (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<p>b", "a\n\nb"), ("<script>x</script>", ""),
    (f"<body><nav><a href=x>Home</a></nav><header>Site</header><article><header><h1>T&eacute;st</h1></header>{ARTICLE}<aside>s</aside>{ARTICLE}<div class='comments'><p>me too</p></div></article><footer>f</footer>", f"Tést\n\n{TEXT}\n\n{TEXT}"),
    (f"<div id=top class='top-menu'>m</div><div><div class=post>{ARTICLE}<ul><li>one<li>two</ul>{ARTICLE}</div><div class='sidebar'><p>s</p></div></div><form>f</form>", f"{TEXT}\n\none\n\ntwo\n\n{TEXT}"),
    (f"<main><p>x <b>y</b>\n z&nbsp;w<br>v</p>{ARTICLE}<table><tr><td>1<td>2</tr><tr><td>3</table><div hidden>h</div><!-- c --></main>", f"x y z w v\n\n{TEXT}\n\n1 2\n\n3"),
    (f"<article>{ARTICLE}<p>broken <a href='x", f"{TEXT}\n\nbroken"),
])
def test_html(html, text):
    assert html_text.main_text(html) == text


def test_html_drops_link_lists_without_class_names():
    links = "".join(f"<li><a href=/{k}>Link number {k}</a></li>" for k in range(30))
    assert html_text.main_text(f"<body><div><ul>{links}</ul></div><div>{ARTICLE * 4}</div></body>") == "\n\n".join([TEXT] * 4)


def test_html_table(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    got = html_text.extract(pages).collect()
    assert len(got) == pages.count() and all(r.n_chars == len(r.text) > 0 for r in got)
    deep = "<div>" * 20_000 + "x"
    assert html_text.main_text(deep) == "x"


def test_pipeline(spark, sf, docs):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "minhash_near_dedup", "benchmark_decontamination", "byte_level_bpe"]
    model = language_id.Classifier(language_id.fit(docs))
    left = {r.doc_id: r.text for r in docs.collect() if not model.one(r.text)[3]}
    last = {}
    for i, t in sorted(left.items()):
        last["".join(c.lower() if c.isascii() else c for c in t)] = i
    left = {i: left[i] for i in last.values()}
    sets = {i: near_dedup.weighted_shingles(t) for i, t in left.items()}
    ids = sorted(left)
    cls = classes(ids, [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if near_dedup.probability_jaccard(*sets[a], *sets[b]) >= 0.8])
    left = {i: left[i] for i in set(cls.values())}
    hits = brute_hits(list(left.items()), [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()])
    c, _ = reference_encoding()
    want = {i: c.encode(t) for i, t in left.items() if not hits[i][4]}
    assert {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, sf).collect()} == want and 50 < len(want) < docs.count()


def test_stages_keep_the_columns(spark, sf, docs):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_arrow_buffers_with_nulls():
    from waygrid.llm.common import text_buffers

    data, offsets = text_buffers(pa.array(["ab", None, "", "c"]))
    assert bytes(data[offsets[0] : offsets[-1]]) == b"abc" and np.diff(offsets).tolist() == [2, 0, 0, 1]


def test_inflate_is_bounded_and_whole():
    import gzip

    raw = gzip.compress(b"a" * 5_000_000) + gzip.compress(b"") + gzip.compress(b"bc" * 700_000)
    for size in (1, 999, 10**7):
        pieces = list(warc.inflate(raw[i : i + size] for i in range(0, len(raw), size)))
        assert b"".join(pieces) == b"a" * 5_000_000 + b"bc" * 700_000 and max(map(len, pieces)) <= warc.READ_BYTES
