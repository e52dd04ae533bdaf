"""Language identification by compression.

A text's letters are encoded once per language, in blocks, with zstandard and that language's
raw-content dictionary; sizes are summed over the whole text; the language with the smallest encoding is predicted, and a text
whose two best encodings are too close is rejected. Letters are lower-cased, everything
else separates words, and a word that repeats at once counts once: runs of one word and
markup compress alike in every language.

Cases: null text, or text without a letter, gives ``und`` with score 0 and is rejected.
Repeated rows and repeated or null doc_ids are judged one by one; a null doc_id belongs
to the learning part. Ties go to the language with the most learnable rows (then the
first by name) and are rejected. Without any learnable row every text is ``und``. Columns
other than those named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, carried, held_out, pick, tidy, words_of

UNDETERMINED = "und"
#: Bounds of the sample that a language's dictionary is made of: its documents, the words
#: of the passage taken from each, the bytes of the dictionary, the languages.
MAX_DOCS, PASSAGE_WORDS, MAX_BYTES, MAX_LANGS = 2000, 24, 256 * 1024, 200
LEVEL = 3
#: A text is encoded in blocks of so many bytes, each with the dictionary at hand, so that a long
#: text tells languages apart as well as a short one.
BLOCK_BYTES = 16 * 1024
#: A text is rejected if second / best - 1 of the encoded sizes is below this.
MIN_MARGIN = 0.002
_LETTER = r"\p{L}"


def letters(text: str) -> bytes:
    """What is encoded: lower-case words of letters, each run of one word once."""
    import regex

    words = regex.sub(r"[^\p{L}]+", " ", text.lower()).split()
    return " ".join(w for w, _ in groupby(words)).encode("utf-8", "replace")


def learn(
    docs: DataFrame, max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES
) -> dict[str, bytes]:
    """Dictionary content of each language, most frequent language first.

    The sample is one passage of PASSAGE_WORDS words, at a place given by a hash of the
    id, from each of the ``max_docs`` learnable rows of a language that come first by
    another hash, so it does not depend on partitions. More than MAX_LANGS languages are
    an error. What comes to the driver is bounded by these parameters.
    """
    rows = pick(docs, doc_id="long", text="string", lang="string").where(
        F.col("lang").isNotNull() & F.col("text").rlike(_LETTER) & ~held_out(F.col("doc_id"))
    )
    counts = rows.groupBy("lang").count().limit(MAX_LANGS + 1).collect()
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages to learn")
    by_lang = Window.partitionBy("lang").orderBy("h", "doc_id", "passage")
    words = words_of(F.col("text"))
    spare = F.greatest(F.size("words") - PASSAGE_WORDS, F.lit(0)) + 1
    passages = (
        rows.withColumn("words", words)
        .withColumn("at", F.pmod(F.xxhash64(F.lit("place"), "doc_id"), spare).cast("int") + 1)
        .select(
            "lang",
            "doc_id",
            F.xxhash64(F.lit("sample"), "doc_id").alias("h"),
            F.array_join(F.slice("words", F.col("at"), PASSAGE_WORDS), " ").alias("passage"),
        )
        .distinct()
    )
    found = (
        passages.withColumn("n", F.row_number().over(by_lang))
        .where(F.col("n") <= max_docs)
        .limit(MAX_LANGS * max_docs)
        .toPandas()
    )
    out = {}
    for lang in [r["lang"] for r in sorted(counts, key=lambda r: (-r["count"], r["lang"]))]:
        part = found[found["lang"] == lang].sort_values("n")
        # zstandard reaches the end of a dictionary with the shortest offsets.
        content = b" ".join(letters(p) for p in reversed(part["passage"].tolist()))
        out[lang] = content[-max_bytes:]
    return out


def _judge(texts: pd.Series, coders: list, langs: list[str], min_margin: float):
    for text in texts:
        data = letters(text) if text else b""
        if not langs or not data:
            yield UNDETERMINED, 0.0, 0.0, True
            continue
        blocks = [data[at : at + BLOCK_BYTES] for at in range(0, len(data), BLOCK_BYTES)]
        sizes = [sum(len(c.compress(b)) for b in blocks) for c in coders]
        best = min(sizes)
        at = sizes.index(best)
        rest = min((s for k, s in enumerate(sizes) if k != at), default=2 * best + 8)
        margin = rest / best - 1
        # Sizes are code lengths: 2 ** -(bits saved) compares the two best as likelihoods.
        score = 1.0 - 0.5 ** (1 + min(60, rest - best))
        yield langs[at], score, margin, margin < min_margin


def detect(
    docs: DataFrame,
    model: dict[str, bytes],
    level: int = LEVEL,
    min_margin: float = MIN_MARGIN,
    carry: bool = False,
) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_margin and lang_rejected for the whole text.

    Columns of these names that are there already are replaced; with ``carry`` the caller's
    row stays whole, as a struct ``row``.
    """
    bound_batches(docs.sparkSession)
    langs = list(model)
    schema = "lang_pred string, lang_score double, lang_margin double, lang_rejected boolean"

    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        import zstandard as zs

        # One set of parameters for all, whatever the sizes of texts and dictionaries.
        params = zs.ZstdCompressionParameters.from_level(
            level, source_size=BLOCK_BYTES, dict_size=MAX_BYTES, write_content_size=False, write_dict_id=False
        )
        coders = []
        for lang in langs:
            content = zs.ZstdCompressionDict(model[lang], dict_type=zs.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(compression_params=params)
            coders.append(zs.ZstdCompressor(dict_data=content, compression_params=params))
        for texts in batches:
            yield pd.DataFrame(
                _judge(texts, coders, langs, min_margin),
                columns=["lang_pred", "lang_score", "lang_margin", "lang_rejected"],
            )

    @F.pandas_udf(schema)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from tidy(encode)(batches)

    new = ["lang_pred", "lang_score", "lang_margin", "lang_rejected"]
    judged = carried(docs, [] if carry else new, text="string").select("row", judge("text").alias("lang"))
    return judged.select("row" if carry else "row.*", "lang.*")


def op10_language_id(docs: DataFrame) -> DataFrame:
    rows = pick(docs, doc_id="long", text="string")
    return detect(rows, learn(docs)).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.col("lang_score").alias("score"),
        F.col("lang_margin").alias("margin"),
        F.col("lang_rejected").alias("rejected"),
    )
