"""Language ID, mixing, packing, token counts, licenses, chat and archives."""

import io
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablecare.llm import chat, langid, licenses, mixing, packing, viterbi, warc
from tablecare.llm.common import components, Workspace
from tests.llm.test_near import brute

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", "  a", "Ünï ΣΑΣ odysseuS Σ", "a\x1cb c\x85d\xa0e", "<|endoftext|> hi <|startoftext|>x", "don't 'Sx 'lly I'M ²½ x×y÷z", "é ́x İstanbul ǅ ﬁ",
       "日本語 テキスト。", "a\tb\r\nc\x0bd", "\x00\x01 µº ª ß ẞ", "'''s ...'re", "😀😀 e😀'll", "Hello, world. abc., .a ,", "x" * 3000]


def test_language_id_learns_and_rejects(spark, tiny, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.expr("crc32(cast(doc_id AS string)) % 5 = 0")
    model = langid.fit(docs.where(~held), fit_rows=200)
    got = langid.predict(docs.where(held), model).join(docs, "doc_id")
    assert got.where("lang = lang_pred").count() >= 0.97 * got.count() and got.where("rejected").count() == 0
    odd = {r.doc_id: r for r in langid.predict(tiny, model).collect()}
    assert all(odd[k].lang_pred == "und" and odd[k].score == 0 and odd[k].rejected for k in (3, 4, 5, 6))
    assert all(odd[k].lang_pred in model.languages and 0 <= odd[k].score <= 1 for k in (1, 7, 9, 10, 11))
    strange = spark.createDataFrame([(1, "ЖЩЮ фывапролд йцукенгшщз " * 20), (2, "字字字字 漢漢 " * 30)], "doc_id long, text string")
    assert langid.predict(strange, model).where("rejected AND lang_pred <> 'und'").count() == 2
    assert langid.keep_known(tiny, model).columns == tiny.columns and langid.keep_known(strange, model).count() == 0
    nothing = langid.fit(none)
    assert not nothing.languages and langid.predict(tiny, nothing).where("lang_pred <> 'und'").count() == 0 and langid.predict(none, model).count() == 0


def test_language_id_rejects_a_language_left_out_and_random_letters(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = F.expr("crc32(cast(doc_id AS string)) % 5 = 0")
    odd = F.expr("size(array_distinct(split(text, '[ \n]+'))) < 0.4 * size(split(text, '[ \n]+')) OR text LIKE '%!!%'")  # a word over and over, or shouting
    random.seed(7)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=random.randint(2, 9)))
    letters = [(i, " ".join(word() for _ in range(150))) for i in range(20)] + [(20, "".join(random.choices("ABCXYZabcdefghxyz0123456789+/", k=900)))]
    strange = spark.createDataFrame(letters, "doc_id long, text string")
    model = langid.fit(docs.where(~held & (F.col("lang") != "fr")))
    out = langid.predict(docs.where("lang = 'fr'"), model)
    assert out.where("rejected").count() >= 0.95 * out.count()
    assert langid.predict(strange, model).where("rejected").count() == len(letters)
    clean = docs.where(held & ~odd)
    got = langid.predict(clean, langid.fit(docs.where(~held)))
    assert got.where("NOT rejected").count() >= 0.99 * got.count() and got.count() > 500


def test_gram_counts_are_those_of_single_texts():
    texts = [b"", b"a", b"The cat; sat.  on", "Größe é".encode(), b"..", b"x" * 70]
    joined, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    every = langid.counts(joined, offsets)
    for row, text in zip(every, texts):
        assert (row == langid.counts(np.frombuffer(text, np.uint8), np.array([0, len(text)]))[0]).all()


def test_mixing_meets_targets_like_a_dense_solution(spark, tiny, none):
    rng = np.random.default_rng(3)
    n, p = rng.integers(1, 500, 400), rng.dirichlet([0.4, 0.5, 0.2], 400)
    rows = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p)], "_tokens long, _p0 double, _p1 double, _p2 double")
    for weights, options in (([0.5, 0.4, 0.1], {}), ([0.9, 0.05, 0.05], {"budget": 1.2, "lowest": 1.0, "highest": 4.0}), ([1.0, 0.0, 0.0], {"rounds": 60})):
        fitted = mixing.fit_rates(rows, weights, **options)
        low, high = options.get("lowest", 0.0), options.get("highest", 8.0)
        h = (n[:, None] * p).T @ p
        target = np.array(weights) * options.get("budget", 1.0) * n.sum()
        r = np.ones(400)
        for _ in range(20_000):  # the same objective, plain projected gradient with a small step
            r = np.clip(r - 0.5 * p @ np.linalg.solve(h, p.T @ (n * r) - target), low, high)
        best, got = p.T @ (n * r) - target, np.array(fitted.after) - target
        assert got @ np.linalg.solve(h, got) <= best @ np.linalg.solve(h, best) + 1e-3 * n.sum()
        rate = np.array([x[0] for x in rows.select(fitted.column()).collect()])
        assert rate.min() >= low and rate.max() <= high and np.allclose(p.T @ (n * rate), fitted.after)


def test_mixing_classifies_and_repeats(spark, tiny, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' ELSE 'low' END").alias("domain"))
    table, model, fitted = mixing.rates(docs, labels, {"high": 0.9, "low": 0.07, "toxic": 0.03})
    got = table.join(labels, "doc_id")
    assert got.where("p_low > 0.5 AND domain = 'low'").count() >= 0.8 * got.where("domain = 'low'").count()
    assert got.where("p_high > 0.5 AND domain = 'high'").count() >= 0.9 * got.where("domain = 'high'").count()
    assert np.abs(np.array(fitted.after) - fitted.targets).max() <= 0.01 * sum(fitted.targets)
    taken = mixing.mixed(docs, model, fitted)
    assert taken.columns == docs.columns
    want = {r.doc_id: r.copies for r in table.where("copies > 0").collect()}
    assert {r.doc_id: r["count"] for r in taken.groupBy("doc_id").count().collect()} == want
    odd, odd_model, odd_rates = mixing.rates(tiny, labels, {"high": 1.0})
    assert odd.count() == 13 and odd.where("doc_id in (3, 4, 5) AND tokens <> 0").count() == 0 and mixing.mixed(tiny, odd_model, odd_rates).columns == tiny.columns
    assert mixing.rates(none, labels, {"high": 1.0})[0].count() == 0
    unlabelled, no_model, no_rates = mixing.rates(tiny, labels.limit(0), {"high": 1.0})
    assert unlabelled.where("rate <> 1 OR copies <> 1").count() == 0 and mixing.mixed(tiny, no_model, no_rates).count() == 13


def test_pipeline_mixing_meets_its_weights_and_keeps_every_document(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    domain = F.expr("CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'high' WHEN quality = 0 THEN 'low' END")
    labelled = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", domain.alias("domain"))
    taken = corpus_pipeline.mixed_domains(spark, docs, sf)
    assert taken.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    model = mixing.fit_domains(docs, labelled)
    sums = mixing.posteriors(taken, model).agg(*[F.sum(F.col("_tokens") * F.col(f"_p{k}")).alias(d) for k, d in enumerate(model.names)], F.sum("_tokens").alias("all")).first()
    assert all(abs(sums[d] / sums["all"] - w) <= 0.015 for d, w in corpus_pipeline.WEIGHTS.items()), sums


def test_budget_dilutes_a_domain_of_a_third(spark):
    rng = np.random.default_rng(4)
    rows = [(int(rng.integers(1, 500)), 0.98 if i % 3 else 0.03, 0.02 if i % 3 else 0.97) for i in range(300)]
    df = spark.createDataFrame(rows, "_tokens long, _p0 double, _p1 double")
    fitted = mixing.fit_rates(df, [0.9, 0.1], budget=None, lowest=1.0, highest=32.0)
    got = np.array(fitted.after) / sum(fitted.after)
    assert np.abs(got - [0.9, 0.1]).max() <= 0.005 and fitted.after[1] >= fitted.before[1]


def test_rates_are_one_expression_for_any_number_of_rounds(spark):
    rows = spark.createDataFrame([(0.2, 0.8), (1.0, 0.0), (0.5, 0.5), (0.03, 0.97)], "_p0 double, _p1 double")
    made = lambda n: mixing.Rates([[0.11 * (-1) ** k, 0.3 / (k + 1) - 0.1] for k in range(n)], 0.5, 1.25, [], [], [])
    sizes = {n: rows.select(made(n).column().alias("rate"))._jdf.queryExecution().analyzed().toString().count("greatest") for n in (2, 40)}
    assert sizes == {2: 1, 40: 1}
    for r in rows.select("_p0", "_p1", made(40).column().alias("rate"), made(0).column().alias("none")).collect():
        want = 1.0
        for a, b in made(40).rounds:
            want = max(0.5, min(1.25, want - (r._p0 * a + r._p1 * b)))
        assert r.rate == want and r.none == 1.0


def test_missing_words_are_found_by_one_search():
    """New parts of a text, plain and strange, are looked up together; words met before don't go to the model again."""
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    for text in ("Ünter, don't--stop's 3x7 (ÿes) l'été", "ünter DON'T stop's İstanbul 日本 ſ Ünter, x\ty", "", "Œuvre über"):
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
    parts = ["Ünter,", "日本", "don't", "(ÿes)"]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.look_up(parts)] == [plain.encode(p, add_special_tokens=False).ids for p in parts]
    assert own.look_up([]) == []


def test_words_give_the_tokenizers_ids():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    for text in ODD:
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text


def test_words_are_remembered_in_little_memory(monkeypatch):
    """However many words come, few are held, and the first ones stay."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHE_PARTS", 60)
    monkeypatch.setattr(packing, "CACHE_WORDS", 40)
    plain, own = Tokenizer.from_file(WORDS), packing.Words(WORDS)
    for i in range(60):
        text = " ".join(["often", "again.", *(f"{a}{b}ing-{i}" for a in ("ba", "du", "ki") for b in ("lo", "nem")), f"only{'abcdefghij'[i % 10]}{'klmnop'[i // 10]}"])
        assert np.frombuffer(own.ids(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids
        assert len(own.words) <= 40 and len(own.parts) <= 60 + len(text.split()) and {"often", "again."} <= own.parts.keys()


def test_cuts_are_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        window = int(rng.integers(4, 20))
        places = np.concatenate([[0], np.cumsum(rng.integers(1, 5, int(rng.integers(1, 30))))])
        penalty = rng.choice([0.0, 3.0, 5.0], len(places))
        found = packing.cuts(places, penalty, window, 2.0)

        def price(cut):
            cost, start = 0.0, 0
            for c in cut:
                size = c - start
                cost += (0 if size & (size - 1) == 0 else window - size) + 2.0 + penalty[list(places).index(c)]
                start = c
            return cost

        best = [0.0] + [np.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                size = places[j] - places[i]
                if size <= window:
                    best[j] = min(best[j], best[i] + (0 if size & (size - 1) == 0 else window - size) + 2.0 + penalty[j])
        assert found[-1] == places[-1] and abs(price(found) - best[-1]) < 1e-9


@pytest.mark.parametrize("stretch", [1 << 19, 200])
def test_packing_round_trip(spark, tiny, none, stretch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORDS)
    rows = tiny.repartition(2, "text").select("doc_id", "text", "id").cache()
    pieces = packing.pack(rows, tokenizer=WORDS, window=256, stretch=stretch).cache()
    want = sorted((str(r.doc_id), plain.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in rows.collect())
    held = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset)):
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length
        if r.start == 0:
            held.setdefault(str(r.doc_id), []).append([])
        assert len(held[str(r.doc_id)][-1]) == r.start
        held[str(r.doc_id)][-1] += ids
    assert sorted((k, ids) for k, x in held.items() for ids in x) == want
    for group in pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
        assert group.n == group.end <= 256
    full = packing.padding(pieces, 256).first()
    assert full.padded <= 0.15 * full.tokens
    assert packing.pack(none, tokenizer=WORDS).count() == 0


def unigram(pieces, byte_fallback=False):
    from tokenizers import Tokenizer, models, pre_tokenizers

    bytes_ = [(f"<0x{i:02X}>", -99.0) for i in range(256)] if byte_fallback else []
    made = Tokenizer(models.Unigram([("<unk>", 0.0), *pieces, *bytes_], 0, byte_fallback))
    made.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return made


def test_counts_are_the_tokenizers():
    pieces = viterbi.ranked_pieces(PIECES)
    library, own = unigram(pieces), viterbi.Counter(pieces)
    for text in ODD:
        assert own.text(text)[0] == len(library.encode(text).ids), text
    random.seed(2)
    for _ in range(200):  # many ties
        some = {"".join(random.choices("abc▁", k=random.randint(1, 3))): random.choice([-1.0, -2.0, -1.5]) for _ in range(12)}
        some = [(p, s) for p, s in some.items() if "▁" not in p[1:]]
        library, own = unigram(some), viterbi.Counter(some)
        for _ in range(5):
            text = "".join(random.choices("abcd  ", k=12))
            assert own.text(text)[0] == len(library.encode(text).ids)


def test_count_only_scores_are_optimal_and_bytes_count():
    own = viterbi.Counter([("▁", -2.0), ("a", -1.0), ("ab", -3.0), ("▁a", -2.5)], byte_fallback=True)
    assert own.text("a") == (1, -2.5, 1) and own.text("aé")[0] == 3 and own.text("") == (0, 0.0, 0)


def test_token_counts_edges(spark, tiny, none):
    got = viterbi.token_counts(tiny, model_file=PIECES).collect()
    assert len(got) == 13 and all(r.n_tokens == 0 for r in got if r.doc_id in (3, 4)) and viterbi.token_counts(none, model_file=PIECES).count() == 0


def test_license_edges(spark, tiny, none):
    texts = ["Released under the MIT License.", "cc by nc cc-by-nc", "Licensed under the Apache License,\nVersion 2.0", "under the mit licenses", "MIT. License under the released",
             "Free. This work is licensed under the GNU General Public License, version 3. End", "worK licensed under the gnu general public license version 3", "under the Kit license", None, ""]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_words int, base string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].last_word, got[0].labels, got[0].score) == (1, 1, 1, "mit", 1.0)
    assert (got[1].n_words, got[1].n_base, got[1].first_word, got[1].last_word) == (6, 2, 0, 3)
    assert got[2].base_labels == "apache-2" and got[2].first_word == 3 and got[3].n_base == 0 and got[4].base_labels == ""
    assert "gpl-3" in got[5].labels.split(",") and "mit" not in got[5].labels and got[5].base_labels == "" and got[5].score == 1.0 and 0.8 <= got[6].score < 1 and got[7].n_base == 0
    assert got[8].n_words == got[9].n_words == 0 and got[8].first_word is None and got[9].labels == ""
    assert licenses.scan(tiny).count() == 13 and licenses.scan(none).count() == 0


def test_wrapped_license_notices_are_found(spark):
    texts = ["# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions\n# are met:\n",
             "This Source Code Form is subject to the terms of the Mozilla Public\r\nLicense, v. 2.0. If a copy of the MPL was not distributed",
             "Licensed under\nthe GNU\nLesser General\nPublic License", "Licensed under the GNU\n\nLesser General Public License", "Licensed under the GNU.\nLesser General Public License"]
    got = {r.doc_id: r.labels for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got[0] == "bsd" and got[1] == "mpl-2" and "lgpl" in got[2].split(",") and got[3] == got[4] == ""


def test_license_join_equals_brute_force(spark):
    random.seed(5)
    vocabulary = [f"t{i}" for i in range(30)]
    templates = [(f"l{i}", " ".join(random.sample(vocabulary, random.randint(1, 9)))) for i in range(12)]
    texts = [". ".join(" ".join(random.choices(vocabulary, k=random.randint(0, 14))) for _ in range(6)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.block, r.template) for r in licenses.template_matches(docs, templates=templates, threshold=0.6).collect()}
    want = set()
    for i, text in enumerate(texts):
        for b, block in enumerate(text.split(". ")):
            for k, (_, t) in enumerate(templates):
                if len(set(block.split()) & set(t.split())) >= 0.6 * len(set(t.split())) - 1e-9:
                    want.add((i, b, k))
    assert got == want and want


def test_license_tags_and_real_notices_are_found_and_equal_the_sql(spark, tmp_path):
    texts = ["SPDX-License-Identifier: Apache-2.0", "// SPDX-License-Identifier: GPL-2.0\nint main;", "spdx license identifier 2 0", "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nPreamble",
             "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that", "Boost Software License - Version 1.0 - August 17th, 2003",
             "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that\n#\n# neither", "a. b! under the MIT License; x\r\n\r\ncc by nc", None, "",
             "This Source Code Form is subject to the terms of the Mozilla Public\r\nLicense, v. 2.0.", "free software you can redistribute", "x" * 200_000 + " released under the mit\x0blicense", "İ K license the\x0c\x0bmit\n \t\nunder"]
    spark.createDataFrame(list(enumerate(texts)) + [(0, "cc by nc cc by nc")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    rows = licenses.scan(spark.read.parquet(f"{tmp_path}/documents.parquet")).drop("n_blocks").collect()
    got = {r.doc_id: r.labels for r in rows if r.doc_id}
    assert got[1] == "gpl-2" and got[2] == "" and got[3] == "gpl-3" and got[4] == "isc" and got[5] == "boost" and got[6] == "bsd" and got[7] == "cc-by-nc,mit" and got[10] == "mpl-2" and got[11] == ""
    assert sorted(r.labels for r in rows if r.doc_id == 0) == ["apache-2", "cc-by-nc"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    cur = con.execute(licenses.sql())
    names = [d[0] for d in cur.description]
    assert sorted(str([r[n] for n in names]) for r in rows) == sorted(str(list(r)) for r in cur.fetchall())


def test_license_phrases_of_a_caller_are_taken_as_words(spark):
    docs = spark.createDataFrame([(1, "it's (c) all rights reserved; a+b")], "doc_id long, text string")
    assert licenses.scan(docs, phrases={"it's (C)": "copyright"}).first().labels == "copyright"
    with pytest.raises(ValueError):
        licenses.scan(docs, phrases={"...": "none"})
    with pytest.raises(ValueError):
        licenses.scan(docs, templates=(("none", " - "),))


def test_licenses_run_no_python(spark, tiny):
    plan = licenses.template_matches(tiny)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_chat_template_is_reversible():
    random.seed(1)
    parts = ["\\", "#", "<", "/", "</turn>", "### Assistant: ", " ", "a", "\n", ":", ">", ""]
    for _ in range(500):
        turns = [("".join(random.choices(parts, k=3)), "".join(random.choices(parts, k=8))) for _ in range(4)]
        whole = "".join(f"{chat.OPEN}{chat.escape_role(r)}: {chat.escape(t)}{chat.CLOSE}" for r, t in turns)
        assert [(r, t) for r, t, _, _ in chat.parse(whole)] == turns


def test_chat_examples(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a #1"), (1, 2, "user", None), (1, 3, "assistant", "b"), (2, 0, "user", "alone"), (3, 1, "assistant", "late"), (3, 0, None, ""),
            (None, 0, "assistant", "x"), (None, None, "user", "first"), (4, 0, "assistant", "twice"), (4, 0, "assistant", "twice"), (1, 4, "user", "bye")]
    turns = spark.createDataFrame([(*r, 5, "x") for r in rows], "conv_id long, turn int, role string, text string, example int, formatted string")
    made = chat.examples(turns).cache()
    mine = sorted((r for r in made.collect() if r.conv_id == 1), key=lambda r: r.example)
    assert [chat.unescape(r.formatted[r.loss_start : r.loss_end]) for r in mine] == ["a #1", "b", ""] and [r.trainable for r in mine] == [True, True, False]
    assert mine[0].formatted == "### user: hi </turn>\n### assistant: a \\#1 </turn>\n" and mine[1].formatted.startswith(mine[0].formatted)
    got = {r.conv_id: r for r in chat.digests(made).collect()}
    assert {k: (r.n_turns, r.n_examples, r.loss_chars) for k, r in got.items()} == {1: (5, 3, 5), 2: (1, 1, 0), 3: (2, 1, 4), None: (2, 1, 1), 4: (2, 2, 10)}
    assert chat.digests(chat.examples(turns.limit(0))).count() == 0


def test_chat_flushes_also_where_only_users_write(spark, monkeypatch):
    rows = [(c, t, "user", "x" * 2000) for c in range(60) for t in range(3)] + [(100, 0, "user", "y" * 300_000), (100, 1, "assistant", "z" * 300_000), (100, 2, "user", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1)
    monkeypatch.setattr(chat, "FLUSH", 20_000)
    made = chat.examples(turns).withColumn("batch", F.spark_partition_id())
    got = made.collect()
    assert len(got) == 62 and sum(r.last for r in got) == 61 and sum(r.trainable for r in got) == 1
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in chat.digests(chat.examples(turns)).collect()} == {c: (3, 0) for c in range(60)} | {100: (3, 300_000)}


def test_many_runs_are_merged_in_levels():
    random.seed(2)
    runs = [sorted((f"k{random.randint(0, 40)}", str(random.randint(0, 9)), i) for _ in range(random.randint(0, 4))) for i in range(100)]
    rows = [r for run in runs for r in run]
    for fan in (2, 7, 512):
        assert list(warc.merged([list(r) for r in runs], fan)) == sorted(rows)


def test_archives_of_long_and_short_payloads(spark, tmp_path):
    long = "é" * 400_000
    rows = [(i, f"http://a/{i % 3}", [None, "", "short", "s" * 999, "t" * 1000, long][i % 6]) for i in range(30)] + [(None, "http://b", "t" * 1000), (None, None, long + "!")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("response", F.lit("x")).withColumn("key", F.lit(1))
    got = warc.archive_round_trip(pages, archive_bytes=1 << 20).collect()
    assert len(got) == 32
    by = {r.page_id: (r.record_type, r.refers_to, r.payload_bytes) for r in got if r.page_id is not None}
    for i, _, html in rows:
        if i is not None:
            size = len((html or "").encode())
            assert by[i] == (("revisit", 24 + i % 6, size) if size >= 1000 and i < 24 else ("response", None, size))
    assert {(r.record_type, r.refers_to) for r in got if r.page_id is None} == {("revisit", 28), ("response", None)}


def test_archives_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://b.example.com/x", big), (2, "http://a.example.com/?q=1", big), (3, None, big), (4, "http://a.example.com/", None), (5, "http://a.example.com/", "small"),
            (6, "http://a.example.com/", "small"), (None, "not a url\r\nX: y", big), (7, "http://[bad", ""), (3, "http://b.example.com/x", big), (8, "http://b.example.com/x", "WARC/1.1\r\n\r\n" * 90)]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, response string")
    got = sorted(warc.archive_round_trip(pages, archive_bytes=500).collect(), key=lambda r: (r.part, r.place))
    assert [(r.url_key, r.captured) for r in got] == sorted((r.url_key, r.captured) for r in got) and len(got) == len(rows)
    kinds = sorted((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got)
    assert kinds == [(0, "revisit", 3, 1200), (1, "revisit", 3, 1200), (2, "revisit", 3, 1200), (3, "response", None, 1200), (3, "response", None, 1200), (4, "response", None, 0),
                     (5, "response", None, 5), (6, "response", None, 5), (7, "response", None, 0), (8, "response", None, 1080)]
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_loser_tree_and_members():
    random.seed(3)
    for k in range(0, 12):
        runs = [sorted((random.randint(0, 9), i) for _ in range(random.randint(0, 7))) for i in range(k)]
        assert list(warc.LoserTree(runs, lambda r: r[0])) == sorted((x for r in runs for x in r))
    data = [b"x" * n for n in (0, 5, 100_000)]
    packed = b"".join(warc._member(d) for d in data)
    assert [m[2] for m in warc.members(io.BytesIO(packed), 7)] == data
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(packed[:-3])))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.members(io.BytesIO(b"no gzip")))


def test_components_reach_the_smallest_id(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)] + [(1000, i) for i in range(1001, 1030)]
    got = components(Workspace(spark), spark.createDataFrame(edges, "a long, b long"))
    want = {i: 0 for i in range(41)} | {i: 100 for i in (100, 150, 200)} | {i: 1000 for i in range(1000, 1030)}
    assert {r.node: r.component for r in got.collect()} == want


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, before = docs, docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        before, kept = kept, Workspace(spark).put(stage(spark, kept, sf), name)
        assert kept.schema.names == docs.schema.names, name
        if name == "near_duplicates":
            linked = brute([(r.doc_id, r.text) for r in before.collect()], 5, (80, 100))
            assert {r.doc_id for r in kept.collect()} == {k for k, (_, _, stays) in linked.items() if stays} and kept.count() < before.count()
        if name == "mixing":
            assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in before.collect()} and kept.count() > before.count()
    pieces = corpus_pipeline.run(spark, sf)
    ends = pieces.where("start + length = doc_tokens").groupBy("doc_id").count()
    assert {r.doc_id: r["count"] for r in ends.collect()} == {r.doc_id: r["count"] for r in kept.groupBy("doc_id").count().collect()}


def test_near_duplicate_stage_goes_by_rows(spark):
    base = " ".join(f"w{i}" for i in range(60))
    near, other = base + " more", " ".join(f"v{i}" for i in range(50))
    rows = [(1, base, "a"), (1, base, "a"), (1, other, "a"), (2, near, "b"), (None, near + " x", "c"), (None, other + " y", None), (3, None, "d"), (3, None, "d"), (4, "", "d"), (5, "unique words of its own here", "e")]
    docs = spark.createDataFrame([(i, t, s, s, 0) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_each(spark, Workspace(spark).put(docs, "docs"), "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, base), (1, other), (3, None), (4, ""), (5, "unique words of its own here")], key=str)
    assert corpus_pipeline.one_of_each(spark, docs.limit(0), "").count() == 0


def test_mixing_draws_by_id_and_text(spark):
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("id"), F.concat(F.lit("text "), "id").alias("text"), F.lit(1.5).alias("rate"))
    taken = rows.select(mixing.copies(F.col("rate"), mixing._key("id", "text")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(taken - 6000) < 200
