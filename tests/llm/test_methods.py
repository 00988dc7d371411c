"""The methods themselves against plain forms of them, and odd inputs."""

import math
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from waygrid.llm import bpe, exact_dedup, html_text, language_id, line_dedup, toxicity

ODD = [(1, "Same text", "a", 1), (2, "same TEXT", "b", 2), (3, None, None, 3), (4, "", "c", 4), (None, "same text", "d", 5), (2, "same TEXT", "b", 2), (9, "a" * 200_000, "g", 8)]
ODD_SCHEMA = "doc_id long, text string, Score string, lang_pred long"


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, ODD_SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], ODD_SCHEMA)


def group_rows(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()), key=str)


def test_rows_come_through_the_directory(spark, monkeypatch):
    d = spark.createDataFrame([(k, f"text {k % 70}") for k in range(200)], "doc_id long, text string")
    whole = group_rows(exact_dedup.exact_groups(d, capacity=4))
    assert len(whole) == 200 and whole == group_rows(exact_dedup.exact_groups(d))
    real = exact_dedup.directory

    def lacking(hashes, capacity):
        cells, depth = real(hashes, capacity)
        gone = cells.agg(F.min("bucket")).first()[0]
        return cells.where(F.col("bucket") != gone), depth

    monkeypatch.setattr(exact_dedup, "directory", lacking)
    assert 0 < exact_dedup.exact_groups(d, capacity=4).count() < 200


def test_buckets_double_until_none_is_overfull(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "STEP", 1)
    h = spark.range(500).select(F.xxhash64("id").alias("h"))
    cells, depth = exact_dedup.directory(h, capacity=7)
    rows = cells.collect()
    bucket = {r.cell: r.bucket for r in rows}
    n, by = {}, {r.bucket: r.local_depth for r in rows}
    for r in h.collect():
        b = bucket[(r.h % 2**64) >> (64 - depth)]
        n[b] = n.get(b, 0) + 1
    assert max(n.values()) <= 7 and max(by.values()) == depth and len(set(by.values())) > 1


def test_chains_of_one_hash_compare_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "hashed", lambda norm: (F.char_length(norm) % 3).cast("long"))
    texts = ["aa", "AA", "bb", "aab", "baa", "BAA", "x", "y", "", None, "aa"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = {}
    for k, t in enumerate(texts):
        by.setdefault((t or "").lower(), []).append(k)
    want = sorted(((k, max(ids), len(ids), k == max(ids)) for ids in by.values() for k in ids), key=str)
    assert group_rows(exact_dedup.exact_groups(d, capacity=1)) == want


def naive_kernel(a, b):
    def phi(x):
        out = {}
        for i, j, k in combinations(range(len(x)), 3):
            if k - i < toxicity.SPAN:
                out[x[i], x[j], x[k]] = out.get((x[i], x[j], x[k]), 0) + toxicity.LAMBDA ** (k - i - 2)
        return out

    pa, pb = phi(a), phi(b)
    norm = lambda p: math.sqrt(sum(v * v for v in p.values()))
    return sum(v * pb.get(t, 0) for t, v in pa.items()) / (norm(pa) * norm(pb))


def test_string_kernel_equals_the_naive_one():
    rng = random.Random(4)
    word = lambda: "^" + "".join(rng.choice("abécd") for _ in range(rng.randint(2, 12))) + "$"
    marks, texts = list(dict.fromkeys(word() for _ in range(12))), [word() for _ in range(30)] + ["^idiot$", "^idxiot$"]
    marks.append("^idiot$")
    got = toxicity.Landmarks(marks).kernel(texts)
    want = np.array([[naive_kernel(t, m) for m in marks] for t in texts])
    assert np.allclose(got, want, atol=1e-5) and abs(got[-2, -1] - 1) < 1e-5 and 0.4 < got[-1, -1] < 1


def test_toxicity_scores_equal_the_machine_word_by_word():
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["an", "er", "th", "ing", "ou", "re"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join([*(word() for _ in range(9)), *(["grumbo"] if k % 3 == 0 else [])]) for k in range(150)]
    machine = toxicity.train(texts, [int(k % 3 == 0) for k in range(150)])

    def score(s):
        f = machine.bias
        for part in toxicity.pieces(s):
            k = np.array([naive_kernel(part, m) if len(part) > 2 else 0 for m in machine.marks.marks])
            if (k[machine.alpha > 0] > toxicity.CUT).any():
                f = max(f, machine.bias + max(0.0, float(toxicity.sharp(k) @ machine.alpha)))
        return f

    tests = ["an grumbo er", "the gruxmbo", "ing ou re", "g r u m b o", ""]
    want = [machine.probability(max((score(s) for s in toxicity.strings(t)), default=machine.bias)) for t in tests]
    assert np.allclose(toxicity.Scorer(machine.plain()).many(tests), want, atol=1e-4) and min(want[0], want[1], want[3]) > 0.5 > max(want[2], want[4])


def test_language_sizes_are_those_of_the_compressor():
    model = {"one": b"the cat sat on the mat and the dog lay on the rug " * 3, "two": b"der hund lag auf dem teppich und die katze sass " * 3}
    c = language_id.Classifier(model)
    for text in ("The cat and the dog!", "Die Katze und der Hund", "on the mat " * 3000):
        raw = " ".join(re.sub(r"[^a-z\x80-\U0010ffff]", " ", text.lower()).split()).encode()
        size = {}
        for lang, own in model.items():
            d = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(language_id.LEVEL, min_match=language_id.MIN_MATCH, dict_size=len(own), write_content_size=0, write_dict_id=0)
            size[lang] = sum(len(zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress(raw[i : i + language_id.BLOCK])) for i in range(0, len(raw), language_id.BLOCK))
        best, other = sorted(size, key=size.get)
        found = c.one(text)
        assert found[0] == best and found[2] == size[other] - size[best] and found[3] == (found[2] < max(1, language_id.MARGIN_SHARE * len(raw)))
        assert abs(found[1] - 1 / (1 + math.exp(max(size[best] - size[other], -700)))) < 1e-9


def test_language_ties_are_rejected_and_name_the_commonest():
    same = b"some words of a language"
    assert language_id.Classifier({"x": same, "a": same}).one("some words")[0::3] == ("x", True)


def test_a_language_of_long_texts_only_has_a_dictionary(spark):
    rows = [(k, "lang word " * 40 if k % 2 else "andere wort " * 2000, "s" if k % 2 else "l") for k in range(40)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(model) == {"s", "l"} and b"andere" in model["l"] and len(model["l"]) <= language_id.DICT_BYTES


def test_scores_of_odd_rows_and_of_none(spark, odd, none):
    model = language_id.fit(spark.createDataFrame([(k, "plain words here", "en") for k in range(9)], "doc_id long, text string, lang string"))
    machine = toxicity.train(["bad zoddle", "good day"], [1, 0]).plain()
    for df, n in ((odd, len(ODD)), (none, 0)):
        a, b = language_id.identify(df, model), toxicity.score(df, machine)
        assert a.count() == n and b.count() == n and [c.lower() for c in a.columns].count("score") == 1 and [c.lower() for c in b.columns].count("score") == 1
    assert bpe.round_trip(none).count() == 0 and corpus_pipeline.STAGES[-1][1](spark, none, "").count() == 0
    assert bpe.encode(none).count() == 0 and line_dedup.drop_lines(none).count() == 0


ARTICLE = "<p>" + "Long text of the article goes on and on. " * 6 + "</p>"
TEXT = ("Long text of the article goes on and on. " * 6).strip()


@pytest.mark.parametrize("around", ["<div class='elementor-widget'>%s</div>", "<div class='share-prices'><article>%s</article></div>", "<div id='public-notice'>%s</div>", "<div class='social-history'>%s</div>", "<form>%s</form>", "<div class=layout-right-sidebar><div class=widget>%s</div><div class=sidebar><p>other</p></div></div>"])
def test_html_names_alone_do_not_drop_the_article(around):
    page = f"<body><div class=menu><a href=x>Home</a></div>{around.replace('%s', ARTICLE)}<footer>f</footer></body>"
    assert html_text.main_text(page) == TEXT


def test_html_articles_side_by_side():
    assert html_text.main_text(f"<body><article>{ARTICLE}</article><article>{ARTICLE}</article><article><a href=x>Next</a></article></body>") == f"{TEXT}\n\n{TEXT}"


def test_html_comments_longer_than_the_article_are_left_out():
    assert html_text.main_text(f"<body><div><p>Short but true.</p></div><div class=comments>{ARTICLE * 9}</div></body>") == "Short but true."


def test_html_nesting_costs_no_more_than_its_size():
    began = time.time()
    assert html_text.main_text("<div>" * 200_000 + "x") == "x" and html_text.main_text("<p>a" + "<b>" * 50_000 + "x" + "</i>" * 50_000) == "ax"
    assert time.time() - began < 20


def plain_densities(page, root):
    """Each node's density from its whole subtree, without running sums."""
    n = len(page.tag)

    def under(k):
        out = {k}
        for j in range(k + 1, n):
            if page.parent[j] in out and not page.noise[j]:
                out.add(j)
        return out

    chars = lambda nodes, linked: sum(page.own[j] for j in nodes if not linked or page.link[j])
    all_c, all_l = chars(under(root), False), chars(under(root), True)
    out = []
    for k in range(n):
        own = under(k)
        c, lc, t, lt = chars(own, False), chars(own, True), len(own) - 1, sum(page.tag[j] == "a" for j in own - {k})
        if page.noise[k] or not c:
            out.append(0.0)
            continue
        d = c / (t or 1)
        if all_l:
            d *= max(0.0, math.log(c / (lc or 1) * (t or 1) / (lt or 1))) / math.log(math.log(c / ((c - lc) or 1) * lc + all_l / all_c * c + math.e))
        out.append(d)
    return out


def test_html_densities_of_whole_pages(spark, sf):
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        page = html_text.Page(r.html)
        root = page.tag.index("body")
        want = plain_densities(page, root)
        got, total = page.densities(root)
        assert np.allclose(got, want)
        assert np.allclose([sum(want[j] for j in range(1, len(want)) if page.parent[j] == k) for k in range(len(want))], total)


def test_line_signatures_agree_as_often_as_the_lines_are_similar():
    rng = random.Random(8)
    hits = total = 0
    for size in (12, 40, 66, 90, 300):
        for _ in range(60):
            base = [rng.choice("abcdefghijklmnop ") for _ in range(size)]
            other = list(base)
            other[rng.randrange(size)] = "#"
            a, b = "".join(base), "".join(other)
            if line_dedup.normalised(a) and line_dedup.jaccard(*line_dedup.shingle_set(a), *line_dedup.shingle_set(b)) >= 0.8:
                keys = [set(line_dedup.signed([line_dedup.normalised(t)])[2].tolist()) for t in (a, b)]
                total += 1
                hits += bool(keys[0] & keys[1])
    assert total > 100 and hits >= 0.98 * total


def plain_bins(line, m):
    """One-permutation MinHash of one line, and its empty bins filled one by one."""
    h = line_dedup.window_hashes(np.array([ord(c) for c in line], np.uint32))
    z = {}
    for x in map(int, h):
        at, value = (x >> 16) * m >> 16, (x << 16 | x >> 16) & 0x7FFFFFFF
        z[at] = min(z.get(at, value), value)
    out = []
    for b in range(m):
        at, t = b, 0
        while at not in z:
            t += 1
            at = (int(line_dedup.mix(np.array([b], np.uint64) * line_dedup._P + np.uint64(t))[0]) >> 32) * m >> 32
        out.append(z[at])
    return out


def test_band_keys_of_lines_are_those_of_each_line_alone():
    rng = random.Random(4)
    lines = ["".join(rng.choices("abcdefghijklmnop ", k=n)) for n in (1, 3, 5, 12, 29, 33, 45, 90, 400, 5, 33)]
    _, _, keys, count, _, sketched = line_dedup.signed(lines)
    assert count.tolist() == [16, 16, 16, 16, 32, 32, 16, 16, 16, 16, 32] and sketched.tolist() == [len(x) >= 90 for x in lines]
    at = np.cumsum(count) - count
    for k, x in enumerate(lines):
        if len(x) > 28:
            want = line_dedup.band_keys(np.array([plain_bins(x, 80)], np.uint32), 16, 5)[0]
            assert keys[at[k] : at[k] + 16].tolist() == want.tolist()
        alone = line_dedup.signed([x])
        assert alone[2].tolist() == keys[at[k] : at[k] + count[k]].tolist()


def test_short_lines_cost_no_filling_of_bins(monkeypatch):
    """Hashes made for lines of a few shingles: one for each place and shingle, and those of the keys."""
    lines, made, mix = [f"{k:03x}" for k in range(2000)], [], line_dedup.mix
    monkeypatch.setattr(line_dedup, "mix", lambda x: made.append(np.size(x)) or mix(x))
    line_dedup.signed(lines)
    assert sum(made) < 200 * len(lines)
