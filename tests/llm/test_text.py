import random
import re
import zlib

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from vozmark.llm import language_id, line_dedup, mixing, quality_rules, token_count, toxicity
from vozmark.llm.common import held_out


def test_token_counts_equal_the_library(spark, data, documents):
    model = token_count.default_model()
    own = sentencepiece.SentencePieceProcessor(model_file=model)
    rng = random.Random(0)
    texts = ["", " ", "▁▁ a▁b", "<s></s><unk> <0x41>", "日本 😀é\u0000", "a" * 500, " " * 99]
    texts += ["".join(rng.choice(" ▁aeth\n\t.ß1日😀ing") for _ in range(rng.randint(0, 50))) for _ in range(2000)]
    counter = token_count.PieceCounter(open(model, "rb").read(), memo=100)
    assert [counter.count(t) for t in texts] == [len(own.encode(t)) for t in texts]
    counter.by_word = False
    assert [counter.count(t) for t in texts[:300]] == [len(own.encode(t)) for t in texts[:300]]
    for rows in (data("documents"), documents):
        got = token_count.count_tokens(rows).collect()
        assert all(r["n_tokens"] == len(own.encode(r["text"] or "")) for r in got)
        assert all(r["n_bytes"] == len((r["text"] or "").encode()) for r in got)
        assert all(r["over_limit"] == (r["n_tokens"] > 4096) for r in got)
    assert token_count.count_tokens(documents.limit(0)).count() == 0


def test_held_out_is_crc32(spark):
    got = spark.range(200).select("id", held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_languages_of_held_out_rows(spark, data, documents):
    docs = data("documents")
    got = language_id.op10_language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.93 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    got = {r["doc_id"]: r for r in language_id.op10_language_id(documents).collect()}
    assert got[2]["lang_pred"] == got[3]["lang_pred"] == got[5]["lang_pred"] == got[6]["lang_pred"] == "und"
    assert got[1]["lang_pred"] in ("en", "fr", "de") and len(got) == 7
    assert language_id.op10_language_id(documents.limit(0)).count() == 0
    assert language_id.op10_language_id(documents.withColumn("lang", F.lit(None).cast("string"))).where("lang_pred <> 'und'").count() == 0


def quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    covered = {k + d for k, g in enumerate(grams) if count[g] > 1 for d in range(8)}
    dup = sum(x in lines[:k] for k, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(covered)


def test_quality_measures_equal_a_loop(spark, data, documents):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))) for _ in range(80)]
    texts += ["a " * 40, "x\ny\nx\n x\n\n", "## | <b>", "é ñ\u00a0ü\u2003z"]
    made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (made, documents, data("documents").limit(60)):
        for r in quality_rules.apply_rules(rows).collect():
            n, chars, symbols, dup, repeat = quality(r["text"])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, repeat)
            failed = n < 20 or 100 * repeat > 30 * n
            assert r["base_failed"] == failed and not (failed and r["kept"])
    assert quality_rules.apply_rules(documents.limit(0)).count() == 0


def test_toxicity_finds_held_out_rows(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [word() for _ in range(20)]
        if toxic:
            words[3] = rng.choice(["zonkelen", "zonkelix", "quarbix"])
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs += [(1000, None), (1001, ""), (None, "zonkelen"), (3, docs[3][1])]
    labels += [(2000, 1, 1), (None, 1, 1), (7, None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.op1_toxicity(d, lab).collect()
    assert len(got) == 604 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert sum(r["predicted"] == (r["doc_id"] % 5 == 0) for r in held) >= 0.97 * len(held)
    assert toxicity.op1_toxicity(d, lab.limit(0)).count() == 604
    assert toxicity.op1_toxicity(d.limit(0), lab).count() == 0


def test_rates_meet_targets_and_stay_nonnegative(spark, data, documents):
    docs, labels = data("documents"), data("labels")
    out = mixing.mix(docs, labels).cache()
    names = [c for c in out.columns if c.startswith("p_")]
    assert out.where("rate < 0").count() == 0 and out.count() == docs.count()
    sums = out.agg(F.sum("n_tokens"), *[F.sum(F.col("rate") * F.col("n_tokens") * F.col(c)) for c in names]).first()
    have = {c[2:]: x / sums[0] for c, x in zip(names, sums[1:], strict=True)}
    share = sum(mixing.TARGETS[c] for c in have)
    left = out.first()["target_error"]
    # Relative to the target, so that small domains count as much as large ones.
    worst = max(abs(x / (mixing.TARGETS[c] / share) - 1) for c, x in have.items())
    assert abs(worst - left) < 1e-6 and left < mixing.TOLERANCE
    assert mixing.mix(documents, labels).count() == 8
    none = mixing.mix(documents, labels.limit(0)).collect()
    assert all(r["rate"] == 1.0 and r["p_all"] == 1.0 for r in none)
    assert mixing.mix(documents.limit(0), labels).count() == 0


def test_rates_equal_a_loop(spark):
    """Posteriors and projected gradient steps by hand, over collected rows."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["word"] * int(rng.integers(3, 90)) + ["!!"] * int(rng.integers(0, 9)))) for i in range(120)]
    marks = [(i, int(rows[i][1].count("!!") < 4), int(len(rows[i][1]) > 200)) for i in range(0, 120, 2)]
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    seen = {r["doc_id"]: r for r in mixing.measured(df).collect()}
    x = np.array([[seen[i][m] for m in mixing.MEASURES] for i in range(120)])
    by = {}
    for i, q, t in marks:
        by.setdefault(f"q{q}_t{t}", []).append(i)
    names = sorted(by)
    score = []
    for d in names:
        own = x[by[d]]
        var = np.maximum(own.var(0), 1e-2)
        score.append(np.log(len(by[d]) / len(marks)) - mixing.SHARPNESS * ((x - own.mean(0)) ** 2 / (2 * var) + 0.5 * np.log(var)).sum(1))
    p = np.exp(np.array(score).T - np.max(score, 0)[:, None])
    p /= p.sum(1, keepdims=True)
    n = np.array([seen[i]["n_tokens"] for i in range(120)])
    want = np.array([mixing.TARGETS[d] for d in names])
    goal = n.sum() * want / want.sum()
    # Plain projected steps with the matrix over all rows.
    weigh = np.linalg.pinv((p * n[:, None]).T @ p + 1e-9 * n.sum() * np.eye(len(names)))
    rate = np.ones(120)
    for _ in range(100_000):
        gap = (rate * n) @ p - goal
        rate = np.maximum(0, rate - p @ (weigh @ gap) - mixing.RIDGE * (rate - 1))
    least = np.abs(((rate * n) @ p - goal) / goal).max()
    got = {r["doc_id"]: r for r in mixing.mix(df, lab).collect()}
    assert np.allclose([[got[i][f"p_{d}"] for d in names] for i in range(120)], p, atol=1e-9)
    left = np.array([got[i]["rate"] for i in range(120)])
    worst = np.abs(((left * n) @ p - goal) / goal).max()
    assert left.min() >= 0 and abs(worst - got[0]["target_error"]) < 1e-6
    # As good as steps without end, or as the tolerance.
    assert worst < max(mixing.TOLERANCE, least * 1.05)


def test_clashing_columns_are_replaced(spark, documents):
    """Names of results, in any case, are replaced; names used inside stay the caller's."""
    results = ["N_Words", "Kept", "LANG_pred", "lang_rejected", "N_Tokens", "TOX_SCORE", "Rate", "p_all"]
    inner = ["row", "lines", "__words", "__lines", "__lang", "lang2", "h", "d", "th", "id", "spans", "a.b"]
    rows = documents
    for n in results + inner:
        rows = rows.withColumn(n, F.lit(f"own {n}"))
    kept = lambda df: df.select(*[F.col(f"`{n}`") for n in inner]).distinct().collect()
    own = [tuple(f"own {n}" for n in inner)]
    got = quality_rules.apply_rules(rows)
    assert got.where("kept").count() == 0 and kept(got) == own
    got = language_id.detect(rows, {"en": b"the cat"})
    assert got.where("lang_pred = 'en'").count() == 4 and kept(got) == own
    got = token_count.count_tokens(rows)
    assert got.where("n_tokens > 1").count() == 6 and kept(got) == own
    got = toxicity.score(rows, toxicity.Model(weights=[0.0] * len(toxicity.voter_names([]))))
    assert got.where("tox_score = 0.5").count() == 8 and kept(got) == own
    got = line_dedup.dedup_lines(rows)
    assert got.where("n_removed = 0").count() == 8 and kept(got) == own
    assert mixing.mix(rows, rows.select("doc_id").limit(0)).count() == 8


def test_label_model_recovers_accuracies_and_a_dependent_pair():
    """Votes drawn with known accuracies; voter 5 repeats voter 4's vote nine times in ten."""
    rng = np.random.default_rng(0)
    n, prior = 20_000, 0.2
    y = rng.random(n) < prior
    caught, wrong = np.array([0.7, 0.6, 0.5, 0.65, 0.6, 0.0]), np.array([0.02, 0.05, 0.02, 0.1, 0.2, 0.0])
    votes = (rng.random((n, 6)) < np.where(y[:, None], caught, wrong)).astype(float)
    alone = rng.random(n) < np.where(y, 0.6, 0.2)
    votes[:, 5] = np.where(rng.random(n) < 0.9, votes[:, 4], alone)
    post, accuracy, pairs = toxicity.label_model(votes, prior)
    true = [y[votes[:, j] > 0].mean() for j in range(6)]
    assert np.abs(accuracy - true).max() < 0.03
    # The pair is found as one, and no other; its correlation is the one within the labels.
    within = np.mean([np.corrcoef(votes[y == k][:, 4], votes[y == k][:, 5])[0, 1] for k in (0, 1)])
    assert [{a, b} for a, b, _ in pairs] == [{4, 5}] and abs(pairs[0][2] - within) < 0.05
    # Posteriors are calibrated where the pair votes alone; counted twice they would not be.
    only = (votes[:, 4] > 0) & (votes[:, 5] > 0) & (votes[:, :4].sum(1) == 0)
    assert abs(post[only].mean() - y[only].mean()) < 0.02
    assert abs(post.mean() - prior) < 0.02


def test_labels_are_a_voter_that_may_be_wrong():
    """Voters of two kinds of rows that never meet: only labels tell that both are telling."""
    rng = np.random.default_rng(1)
    n = 8000
    y, kind = rng.random(n) < 0.2, rng.random(n) < 0.5
    votes = np.stack([(rng.random(n) < np.where(y & (kind == (j < 3)), 0.6, 0.005)) for j in range(6)], 1).astype(float)
    noisy = np.where(rng.random(n) < 0.05, ~y, y)
    post, accuracy, _ = toxicity.label_model(votes, 0.2, np.where(noisy, 1.0, -1.0))
    true = [y[votes[:, j] > 0].mean() for j in range(6)]
    assert np.abs(accuracy[:6] - true).max() < 0.06 and accuracy[6] > 0.93
    # Wrong labels are outvoted in part.
    assert ((post > 0.5) == y).mean() > (noisy == y).mean()


def test_terms_are_chosen_for_rows_left():
    found = [[0, 1]] * 8 + [[2]] * 6 + [[1, 3]] * 9 + [[]] * 5
    truth = np.array([1] * 14 + [0] * 14)
    # 1 stands beside 0 and in others; 3 is in no toxic row.
    assert toxicity.choose(found, truth, [" aa", " bb", " cc", " dd"]) == [0, 2]


def test_very_long_texts(spark):
    """A text of 200,000 words through the operators on single texts."""
    words = " ".join(f"wort{i % 977}" for i in range(200_000))
    df = spark.createDataFrame([(1, words), (2, words + " idiot idiot"), (3, "idiot")], "doc_id long, text string")
    none = df.select("doc_id", F.lit(None).cast("int").alias("toxic"))
    got = {r["doc_id"]: r["score"] for r in toxicity.op1_toxicity(df, none).collect()}
    assert got[2] == got[3] > got[1]
    assert {r["n_words"] for r in quality_rules.apply_rules(df).collect()} == {200_000, 200_002, 1}


def test_language_ties_and_long_texts(spark):
    """Equal dictionaries tie and are rejected; the margin of a long text is its blocks' together."""
    df = spark.createDataFrame([(1, "le chat noir dort ici")], "doc_id long, text string")
    got = language_id.detect(df, {"x": b"le chat", "y": b"le chat"}).first()
    assert got["lang_pred"] == "x" and got["lang_rejected"] and got["lang_margin"] == 0


def test_sizes_and_verdicts_of_texts_by_hand(spark, data):
    """Sizes worked out here with zstandard; long texts made of known ones keep their language and margin."""
    import zstandard as zs

    docs = data("documents").where("lang is not null and text is not null")
    model = language_id.learn(docs)
    rows = {r["lang"]: r["text"] for r in docs.where("length(text) > 500").orderBy("doc_id").collect()}
    texts = {}
    for k, (lang, text) in enumerate(sorted(rows.items())):
        words = text.split()
        random.Random(k).shuffle(words)
        texts[2 * k] = (lang, text)
        texts[2 * k + 1] = (lang, " ".join(random.Random(k).choices(words, k=300_000)))
    df = spark.createDataFrame([(i, t) for i, (_, t) in texts.items()], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language_id.detect(df, model).collect()}
    params = zs.ZstdCompressionParameters.from_level(
        language_id.LEVEL, source_size=language_id.BLOCK_BYTES, dict_size=language_id.MAX_BYTES, write_content_size=False, write_dict_id=False
    )
    for i, (lang, text) in texts.items():
        data_ = language_id.letters(text)
        sizes = {}
        for name, content in model.items():
            d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=params)
            c = zs.ZstdCompressor(dict_data=d, compression_params=params)
            step = language_id.BLOCK_BYTES
            sizes[name] = sum(len(c.compress(data_[k : k + step])) for k in range(0, len(data_), step))
        first, second = sorted(sizes.values())[:2]
        assert sizes[got[i]["lang_pred"]] == first and abs(got[i]["lang_margin"] - (second / first - 1)) < 1e-12
        assert got[i]["lang_pred"] == lang and not got[i]["lang_rejected"], (i, lang)
