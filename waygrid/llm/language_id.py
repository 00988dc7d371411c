"""Language ID by compression: the language whose zstandard raw-content dictionary makes the text smallest.

A dictionary holds training texts, in the order of a hash of their ids, up to `dict_bytes`; that sample (SAMPLE_DOCS texts of each
language, whole ones of SAMPLE_CHARS characters at most and, where these are too few, as much of longer ones) is all the model
keeps. Before compression texts are lower-cased and runs
of ASCII other than letters become one space. They are cut into blocks of BLOCK bytes, all of them are compressed against each
dictionary, and the sizes are summed, so long texts do not become their own dictionary.
"""

from __future__ import annotations

import math

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append, held_out, schema_with, ship

DICT_BYTES, SAMPLE_DOCS, SAMPLE_CHARS = 96 << 10, 96, 8_000
#: Matches of three bytes count: short words are what tells short texts apart.
BLOCK, LEVEL, MIN_MATCH = 8 << 10, 9, 3
#: Bytes by which the best language must beat the second, in all and for each byte of the text. Of 1,960 held-out documents of sf0.1
#: 21 are decided by less, 3 of them wrongly; of the others one is.
MIN_MARGIN, MARGIN_SHARE = 1, 0.002
UNKNOWN = "und"
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("margin", T.LongType()), T.StructField("rejected", T.BooleanType())]
_LETTER = regex.compile(r"\p{L}")
_LETTERS = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


def normalised(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_LETTERS).split())


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", dict_bytes: int = DICT_BYTES, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """Dictionaries by language, the commonest first, from rows that are not held out and have text and lang. No such rows: none."""
    rows = docs.select(docs[id_col].alias("i"), docs[text_col].cast("string").alias("t"), docs[lang_col].cast("string").alias("l"))
    rows = rows.where(~held_out(F.col("i")) & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, 2 * sample_docs / n))])
    place = (F.shiftrightunsigned(F.xxhash64("i", "t"), 12) / float(1 << 52)).alias("p")
    taken = rows.select("l", F.substring("t", 1, sample_chars).alias("t"), (F.char_length("t") > sample_chars).alias("cut"), place).where(F.col("p") < share[F.col("l")]).collect()
    model: dict[str, bytes] = {}
    for lang in sorted(counts, key=lambda x: (-counts[x], x)):
        out, n = [], 0
        for r in sorted((r for r in taken if r["l"] == lang), key=lambda r: (r["cut"], r["p"], r["t"]))[:sample_docs]:
            raw = normalised(r["t"]) + b" "
            if n + len(raw) <= dict_bytes or not out:
                out.append(raw)
                n += len(raw)
        model[lang] = b"".join(out)[:dict_bytes]
    return model


class Classifier:
    def __init__(self, model: dict[str, bytes]):
        self.by = []
        for lang, raw in model.items():
            d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            p = zstandard.ZstdCompressionParameters.from_level(LEVEL, min_match=MIN_MATCH, dict_size=len(raw), write_content_size=0, write_dict_id=0)
            self.by.append((lang, zstandard.ZstdCompressor(dict_data=d, compression_params=p).compress))

    def one(self, text: str | None, min_margin: int = MIN_MARGIN, margin_share: float = MARGIN_SHARE) -> tuple[str, float, int, bool]:
        if not text or not self.by or not _LETTER.search(text):
            return UNKNOWN, 0.0, 0, True
        raw = normalised(text)
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        sizes = sorted(((sum(len(f(b)) for b in blocks), lang) for lang, f in self.by), key=lambda x: x[0])
        if len(sizes) == 1:
            return sizes[0][1], 1.0, 0, False
        score = 1 / sum(math.exp(max(sizes[0][0] - n, -700)) for n, _ in sizes)
        margin = sizes[1][0] - sizes[0][0]
        return sizes[0][1], score, margin, margin < max(min_margin, margin_share * len(raw))


def identify(docs: DataFrame, model: dict[str, bytes], text_col: str = "text", min_margin: int = MIN_MARGIN, margin_share: float = MARGIN_SHARE, drop: bool = False, keep_text: bool = True) -> DataFrame:
    """docs with lang_pred, score (0 to 1), margin (bytes) and rejected; drop: docs as they are, without the rejected rows.

    Null text, or text without a letter, is 'und', score 0, rejected; a margin below min_margin, or below margin_share of the
    normalised text's bytes, is rejected too, and lang_pred still names the best (of a tie, the commonest in training). Input columns of the same names are replaced.
    """
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    schema = docs.schema if drop else schema_with(docs, FIELDS)
    if not keep_text:
        schema = T.StructType([f for f in schema.fields if f.name != text_col])
    names = schema.names

    def run(batches):
        c = Classifier(sent.value)
        for b in batches:
            found = [c.one(t, min_margin, margin_share) for t in b.column(b.schema.get_field_index(text_col)).to_pylist()]
            if drop:
                yield b.filter(pa.array([not x[3] for x in found], pa.bool_()))
            else:
                cols = zip(FIELDS, (pa.string(), pa.float64(), pa.int64(), pa.bool_()), strict=True)
                yield append(b, {f.name: pa.array([x[k] for x in found], kind) for k, (f, kind) in enumerate(cols)}).select(names)

    return docs.mapInArrow(run, schema)
