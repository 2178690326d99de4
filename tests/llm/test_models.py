"""Language, quality, URLs, licences, tokens and the pipeline."""

import random
import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plexivec.llm import language, licenses, queries, quality, token_shards, urls
from plexivec.sources.tables import table
from tests.conftest import SMALL

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SF = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    got = queries.op1_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id")
    assert got.count() == table(spark, SF, "documents").count()
    assert got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    assert got.filter("score < 0 or score > 1").count() == 0


def brute_profile(texts, size):
    counts = Counter()
    for t in texts:
        for w in re.split(r"[\W\d_]+", t.lower()):
            if w:
                p = f" {w} "
                counts.update([*w, *(p[i : i + 2] for i in range(len(p) - 1)), *(p[i : i + 3] for i in range(len(p) - 2))])
    code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], code(x[0])))][:size]


def test_language_is_out_of_place(spark):
    rows = [(i, ["the cat sat on the mat with that hat", "der hund ist in dem haus und bellt"][i % 2], ["en", "de"][i % 2]) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = language.learn_profiles(df, size=50)
    profiles = {lang: brute_profile([t for _, t, l in rows if l == lang], 50) for lang in ("de", "en")}
    for text in ("that cat", "das haus und der hund", "x1y", "Cat  CAT!"):
        own = brute_profile([text], 50)
        d = {l: sum(abs(i - prof.index(g)) if g in prof else 50 for i, g in enumerate(own)) for l, prof in profiles.items()}
        best = min(sorted(d), key=d.get)
        assert p.predict(text) == (best, pytest.approx(1 - d[best] / (50 * len(own))))


def test_language_edges(spark, monkeypatch):
    df = spark.createDataFrame([(1, None, None), (2, "", "en"), (3, "123 !?", "en"), (4, "hello there", "en"), (4, "hello there", "en")], "doc_id long, text string, lang string").withColumn("score", F.lit("clash"))
    got = language.identify_language(df, language.learn_profiles(df)).collect()
    assert sorted((r["doc_id"], r["lang_pred"]) for r in got) == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    empty = language.learn_profiles(df.limit(0))
    assert empty.predict("hello") == ("und", 0.0) and language.identify_language(df.limit(0), empty).count() == 0
    whole = language.counted("hello there " * 50)
    monkeypatch.setattr("plexivec.llm.charhash.SPAN", 37)
    cut = language.counted("hello there " * 50)
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_quality_against_labels(spark):
    got = queries.op5_quality(spark, SF).join(table(spark, SF, "labels"), "doc_id").toPandas()
    got = got.set_axis(["doc_id", "score", "kept", "label", "toxic"], axis=1)
    assert got[got.label == 1].kept.mean() > 0.97 and got[got.label == 0].kept.mean() < 0.3


def test_em_recovers_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20000) < 0.8
    votes = np.stack([np.where(rng.random(20000) < 0.3, 0, np.where(rng.random(20000) < a, np.where(good, 1, -1), np.where(good, -1, 1))) for a in (0.95, 0.9, 0.9, 0.85)], 1)
    patterns, where, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    p = quality.posterior(patterns, counts)[where.ravel()]
    assert ((p > 0.5) == good).mean() > 0.93 and p.mean() == pytest.approx(0.8, abs=0.03)


def brute_votes(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    sentences = [s.lstrip(" \t\x0b\x0c\r") for s in re.split(r"[.!?\n]", text)]
    sentences = [s for s in sentences if s]
    lines = [x for x in text.split("\n") if x]
    n, chars, ns = max(len(words), 1), max(len(text), 1), max(len(sentences), 1)
    runs = sum(len(m.group()) // 2 for m in re.finditer(r"([#$%&*!=~|])\1+", text)) + len(re.findall(r"(?<= )\|(?= )", text))
    odd = sum(not (z.isalpha() or unicodedata.category(z)[0] == "N" or unicodedata.category(z)[0] == "L" or z in ".,;:?)\"'") for z in re.findall(r"[^\x20\x09-\x0D](?=[\x20\x09-\x0D])", text))
    ended = sum(x.rstrip(" \t\x0b\x0c\r")[-1:] in tuple(".!?:") for x in lines) / max(len(lines), 1)
    enough = n >= 8
    rates = {
        "marks": (sum(x in quality.MARKS for x in text) / chars, 0.03, 0.005, True),
        "marked_words": (sum(any(x in quality.MARKS for x in w) for w in words) / n, 0.2, 0.05, enough),
        "mark_runs": (runs / n, 0.15, 0.03, enough),
        "word_ends": (odd / n, 0.2, 0.08, enough),
        "capitals": (sum(unicodedata.category(x) == "Lu" for x in text) / chars, 0.3, 0.1, enough),
        "stutter": (sum(a == b for a, b in zip(words, words[1:])) / n, 0.25, 0.1, enough),
        "repeated_sentences": (1 - len(set(sentences)) / ns, 0.5, 0.1, ns >= 4),
        "vocabulary": (1 - len(set(words)) / n, 0.75, 0.55, n >= 30),
        "cries": (text.count("!") / n, 0.3, 0.05, enough),
        "line_ends": (1 - ended, 0.7, 0.3, enough),
    }
    votes = {"blank": -1 if not words else 0} | {k: -1 if r > bad and sure else 1 if r < good else 0 for k, (r, bad, good, sure) in rates.items()}
    return [votes[k] for k in quality.LABELLERS]


ODD_TEXTS = ["", " ", "\n", "a", "a | b | c |", "##### ** a == b", "A B C D E F G H I", "É É é. Ü! ??\n x", "w w w w w w w w w", "x.\n\ny!  \nz: \t\nlast", ". . . . . a. a. a. a.", "| | | | | | | |", "a|\n|b ~~~", "漢字 かな 123 ½ \U0001f600 !", "end#"]


def test_votes_against_plain_python(spark):
    texts = [r["text"] or "" for r in table(spark, SMALL, "documents").select("text").collect()] + ODD_TEXTS * 2
    got = np.concatenate([quality.label_votes(b) for b in quality._blocks(pa.array(texts))])
    for text, votes in zip(texts, got.tolist()):
        assert votes == brute_votes(text), text[:200]


def test_scorer_against_plain_features():
    rng = np.random.default_rng(4)
    scorer = quality.Scorer(rng.standard_normal(1 << quality.BITS), 0.3)
    texts = [None, *ODD_TEXTS, "some words some words here " * 30, "same same same"]
    for text, score in zip(texts, scorer.scores(texts)):
        z = scorer.intercept + sum(float(scorer.weights[b].sum()) * v for b, v in quality.features(text))
        assert score == pytest.approx(1 / (1 + np.exp(-z)) if (text or "").strip() else 0.0, abs=1e-9)


def test_quality_query_against_plain_python(spark):
    """The query's scores are those of EM on plain votes and a fit on the documents that the hash draws."""
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    scorer = quality.fit_scorer(docs)
    got = {r["doc_id"]: r["quality"] for r in queries.op5_quality(spark, SMALL).collect()}
    rows = docs.collect()
    votes = [tuple(brute_votes(r["text"] or "")) for r in rows]
    patterns, counts = zip(*sorted(Counter(votes).items()))
    good = dict(zip(patterns, quality.posterior(np.array(patterns), np.array(counts))))
    for r in rows:
        z = scorer.intercept + sum(float(scorer.weights[b].sum()) * v for b, v in quality.features(r["text"]))
        assert got[r["doc_id"]] == pytest.approx(1 / (1 + np.exp(-z)) if (r["text"] or "").strip() else 0.0, abs=1e-6)
    sure = [(good[v] > 0.5) == (got[r["doc_id"]] >= 0.5) for v, r in zip(votes, rows) if abs(good[v] - 0.5) > 0.4]
    assert np.mean(sure) > 0.95


def test_quality_draw_is_bounded(spark):
    """A third of all rows are copies of one text: only their share is drawn, whatever the text's hash."""
    from pyspark.sql import DataFrame

    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "A hot text with some words. It is a copy.").otherwise(F.concat(F.lit("Text number "), F.col("id"), F.lit(" has words of its own. And an end."))).alias("text"))
    seen = []
    original = quality.staged
    quality.staged = lambda df, name: seen.append(original(df, name)) or seen[-1]
    try:
        quality.fit_scorer(rows, train_docs=600)
    finally:
        quality.staged = original
    assert isinstance(seen[0], DataFrame) and 400 < seen[0].count() < 800


def test_quality_edges(spark):
    rows = [(1, None), (2, " \n"), (3, "Plain words in a sentence."), (3, "Plain words in a sentence."), (4, "a " * 200_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("votes", F.lit("clash"))
    got = {r["doc_id"]: (r["quality"], r["kept"]) for r in quality.score_quality(df, quality.fit_scorer(df)).collect()}
    assert got[1] == got[2] == (0.0, False) and len(got) == 4
    none = df.limit(0)
    assert quality.score_quality(none, quality.fit_scorer(none)).count() == 0
    same = quality.fit_scorer(spark.createDataFrame([(1, "One sentence of words here.")] * 3, "doc_id long, text string"))
    assert same.score("Anything") == 0.5


def plain_rule(host, path):
    best = None
    for rule, verdict in urls.RULES:
        name, _, tail = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return best or (None, None)


def test_urls(spark):
    given = [None, "", "no scheme", "http://", "HTTP://A.Example.NET/en/1?x#y", "http://example.net/en/", "http://example.net/EN/", "http://net", "http://net/x", "http://x.net?q=/", "ftp://b.example.com/de/é", "s://u@h.org:80/fr/#://", "http://notexample.com/de/", "http://spam-farm.example.org/en/1", "http://blog.thander.example.org/en/5"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)] * 2, "page_id long, url string").withColumn("host", F.lit("clash"))
    rows = urls.judge_urls(df, urls.fit_url_model(spark)).collect()
    assert len(rows) == 2 * len(given)
    for r in rows:
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = host.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        rule, verdict = plain_rule(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] == (verdict or ("block" if r["block_score"] >= 0.5 else "allow"))
    by = {r["page_id"]: r["verdict"] for r in rows}
    assert by[13] == "block" and by[14] == "allow"


def test_url_model_on_pages(spark):
    got = queries.op6_url_filter(spark, SF).filter("rule is null").toPandas()
    bad = got["host"].str.contains(r"(?:casino|pills|spam|ads-track|adult|bets)")
    assert (got[bad]["verdict"] == "block").mean() > 0.9 and (got[~bad]["verdict"] == "allow").mean() > 0.95


def test_url_rules_of_any_number(spark):
    """A table of rules gives what the compiled rules give and what every rule tried in turn gives."""
    rng = random.Random(5)
    label = lambda: rng.choice(["com", "net", "a", "b", "", "é"])
    path = lambda: "/" + "".join(rng.choice(["x", "y/", "é", "", "."]) for _ in range(rng.randrange(5)))
    name = lambda: ".".join(label() for _ in range(rng.randrange(1, 4)))
    rules = [(name() + rng.choice([path(), "/", "/", ""]), rng.choice(["allow", "block"])) for _ in range(150)]
    rules += [("com/", "allow"), ("com/", "block"), ("com", "allow")]
    given = [None, "", "no scheme"] + [f"http://{name()}{rng.choice([path(), '', '?q', path() * 200])}" for _ in range(300)] + ["http://a.com/x"] * 300
    df = spark.createDataFrame(list(enumerate(given)), "page_id long, url string").withColumn("rule", F.lit("clash")).withColumn("name", F.lit("clash"))
    host, at = urls.host_and_path(F.col("url"))
    rows = df.select("page_id", host.alias("host"), at.alias("path")).cache()
    listed = spark.createDataFrame(rules + [(None, "block")], "rule string, verdict string")
    got = {r["page_id"]: r["_rule"] for r in urls.joined_rules(rows, listed).collect()}
    assert len(got) == len(given) and sum(r is not None for r in got.values()) > 100
    order = lambda r: (-len(r[0]), r[0], r[1] != "block")
    for r in rows.collect():
        fits = [x for x in rules if (lambda n, t: (r["host"] == n or r["host"].endswith("." + n)) and r["path"].startswith("/" + t))(x[0].partition("/")[0], x[0].partition("/")[2])]
        found = got[r["page_id"]]
        assert (tuple(found) if found else None) == min(fits, key=order, default=None)
    few = rules[:12] + rules[-3:]
    want = {r["page_id"]: r["_rule"] for r in rows.withColumn("_rule", urls.best_rule(F.col("host"), F.col("path"), few)).collect()}
    assert {r["page_id"]: r["_rule"] for r in urls.joined_rules(rows, spark.createDataFrame(few, "rule string, verdict string")).collect()} == want
    model = urls.fit_url_model(spark)
    judged = urls.judge_urls(df, model, rules=listed).select("page_id", "name", "rule", "verdict").collect()
    assert {r["page_id"]: r["rule"] for r in judged} == {k: r and r["rule"] for k, r in got.items()} and {r["name"] for r in judged} == {"clash"}
    assert urls.judge_urls(df.limit(0), model, rules=listed).count() == 0


def test_url_model_against_numpy(spark):
    """The fitted weights on the same n-grams, hashed by the same function, in plain Python."""
    model = urls.fit_url_model(spark)
    hashing, logistic = model.stages[1], model.stages[2]
    given = ["http://www.luckyspin-casino.com/bonus", "http://a.b/", "no scheme", "https://docs.site.org/intro/page.html?q=1", "http://x.com/" + "long/" * 30_000, "http://é.com/ü"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(given)], "page_id long, url string").withColumn("block_score", F.lit("clash"))
    weights, bias = logistic.coefficients.toArray(), logistic.intercept
    for r in urls.judge_urls(df, model).collect():
        grams = {m + t[i : i + n] for m, x in (("h", r["host"]), ("p", r["path"])) for t in [f"^{x}$"] for n in (3, 4, 5) for i in range(max(len(t) - n + 1, 1))}
        z = bias + sum(weights[b] for b in {hashing.indexOf(g) for g in grams})
        assert r["block_score"] == pytest.approx(1 / (1 + np.exp(-z)))
    assert urls.judge_urls(df.limit(0), model).count() == 0


def test_url_model_on_held_out_hosts(spark):
    """Every fifth host is left out of the table; the model tells most of them by their n-grams."""
    held = set(sorted(urls.BLOCK_HOSTS)[::5] + sorted(urls.ALLOW_HOSTS)[::5])
    rows = [(u, y, any(f"/{b}{h}." in u for h in held for b in urls.BEGINNINGS)) for u, y in urls.labelled_urls()]
    model = urls.fit_url_model(spark, [(u, y) for u, y, out in rows if not out])
    got = urls.judge_urls(spark.createDataFrame([(u, y) for u, y, out in rows if out], "url string, label double"), model, rules=()).toPandas()
    assert ((got["block_score"] >= 0.5) == (got["label"] > 0.5)).mean() > 0.8


def test_licences(spark):
    for rule in ("MIT", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0"):
        names = next(r for n, r in licenses.RULES if n == rule)
        text = "Some words first.\n" + "\n".join(licenses.SENTENCES[n].replace(" of ", "\nof ") for n in names) + "\nAnd more."
        found = licenses.licences(text)
        assert [(n, ids) for n, ids, _, _ in found] == [(rule, " ".join(names))]
        assert text[found[0][2] : found[0][3]].startswith(licenses.SENTENCES[names[0]][:10])
    assert licenses.licences("Nothing. Released under the MIT License.\nLicensed under the Apache License, Version 2.0.") and not licenses.licences("He released under the MIT License of old.")
    assert all(any(a in s.lower() for a in licenses.ANCHORS) for s in licenses.SENTENCES.values())
    df = spark.createDataFrame([(1, None), (2, ""), (3, "İ. Released under the MIT License"), (4, "x " * 100_000 + ". Licensed under CC BY 4.0.")], "doc_id long, text string").withColumn("begin", F.lit(1))
    assert sorted((r["doc_id"], r["licence"]) for r in licenses.scan_licences(df).collect()) == [(3, "MIT"), (4, "CC-BY-4.0")]
    assert licenses.scan_licences(df.limit(0)).count() == 0


def brute_sentences(text):
    """All words of the text, sentence ends between them, every known sentence at every start."""
    low = text.lower()
    words = list(re.finditer(r"[^\W_]+", low))
    ends = [m.start() for m in re.finditer(r"[.!?;:](?=\s|$)|\n", low)]
    known = {licenses.sentence_words(s): n for n, s in licenses.SENTENCES.items()}
    edge = lambda i: i in (0, len(words)) or any(words[i - 1].end() <= e < words[i].start() for e in ends)
    out, i = [], 0
    while i < len(words):
        fits = [k for k in known if edge(i) and tuple(w.group() for w in words[i : i + len(k)]) == k and edge(i + len(k))]
        if fits:
            k = max(fits, key=len)
            out.append((known[k], words[i].start(), words[i + len(k) - 1].end()))
            i += len(k)
        else:
            i += 1
    return out


def test_licence_sentences_against_brute_force():
    rng = np.random.default_rng(11)
    pieces = [*licenses.SENTENCES.values(), "Some words.", "copyright (c) 2020 A_B", "1.", "\n\n", "and licensed", "Permission is hereby granted,", "  * "]
    for _ in range(150):
        text = " ".join(pieces[k].replace(" ", "\n" if rng.random() < 0.1 else " ") for k in rng.integers(0, len(pieces), 12))
        assert licenses.sentences(text) == brute_sentences(text), text


def test_licence_rules_need_near_sentences():
    grant, notice = licenses.SENTENCES["mit-grant"], licenses.SENTENCES["mit-notice"]
    assert [x[1] for x in licenses.licences(f"{grant}\n\n{notice}")] == ["mit-grant mit-notice"]
    assert [x[1] for x in licenses.licences(f"{grant}\n{'Other words. ' * 800}\n{notice}")] == ["mit-grant"]
    long = f"{grant}\n\n{notice}\n" + "word words_and more; " * 200_000 + f"\n{licenses.SENTENCES['cc0']}."
    assert [x[0] for x in licenses.licences(long)] == ["MIT", "CC0-1.0"]
    assert all(n in licenses.SENTENCES for _, rule in licenses.RULES for n in rule)


def test_licences_on_documents(spark):
    lines = {"Licensed under CC BY-NC 4.0": "CC-BY-NC-4.0", "Released under the MIT License": "MIT", "Licensed under the Apache License, Version 2.0": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3": "GPL-3.0-only"}
    want = {(r["doc_id"], lic) for r in table(spark, SF, "documents").collect() for line, lic in lines.items() if line in r["text"]}
    assert {(r["doc_id"], r["licence"]) for r in queries.op4_licences(spark, SF).collect()} == want


def test_permutation():
    for domain in (1, 2, 3, 10, 1000, 4097):
        for tweak in (0, 1, 5):
            assert sorted(token_shards.permute(np.arange(domain, dtype=np.uint64), domain, 9, tweak).tolist()) == list(range(domain))
    a, b = (token_shards.permute(np.arange(1000, dtype=np.uint64), 1000, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(a, np.arange(1000))[0, 1]) < 0.15


def test_token_round_trip(spark, tmp_path):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    extra = spark.createDataFrame([(None, "null id"), (-5, None), (-6, ""), (-7, "tail " * 90_000), (3, "a repeated id"), (-8, "\n\n  x \x00 é 漢字")], "doc_id long, text string")
    docs = docs.unionByName(extra)
    layout = token_shards.write_shards(docs, str(tmp_path / "t"), TOKENIZER, 50256, seq_len=64, shard_bytes=1 << 18)
    rows = token_shards.read_slots(spark, layout).orderBy("slot").collect()
    assert [r["slot"] for r in rows] == list(range(len(rows))) and len({r["shard"] for r in rows}) > 3
    enc = token_shards.encoder(TOKENIZER)
    texts = {}
    for r in sorted(rows, key=lambda r: r["part"]):
        texts.setdefault(r["doc_id"], []).extend(r["ids"][: r["n_tokens"]])
        assert all(t == 50256 for t in r["ids"][r["n_tokens"] :])
    want = {(-1 if r["doc_id"] is None else r["doc_id"]): r["text"] for r in docs.collect() if r["text"] and r["doc_id"] != 3}
    assert {k: enc.decode(v[:-1]) for k, v in texts.items() if k != 3} == want and set(texts) == set(want) | {3}
    again = token_shards.write_shards(docs.repartition(5), str(tmp_path / "u"), TOKENIZER, 50256, seq_len=64, shard_bytes=1 << 18)
    assert [(r["slot"], r["sha256"]) for r in token_shards.read_slots(spark, again).orderBy("slot").collect()] == [(r["slot"], r["sha256"]) for r in rows]
    part = token_shards.read_slots(spark, layout, 100, 50).orderBy("slot").collect()
    assert [(r["slot"], r["sha256"]) for r in part] == [(r["slot"], r["sha256"]) for r in rows[100:150]]
    file = token_shards.shard_table(spark, layout).orderBy("shard").first()
    with open(file["file"].removeprefix("file:"), "rb") as f:  # a slot is at its number times the stride
        f.seek(2 * layout.stride)
        assert np.frombuffer(f.read(layout.stride), layout.dtype, 64, token_shards.HEAD.itemsize).tolist() == rows[2]["ids"]


def test_places_are_a_permutation():
    for n_docs, n_parts in ((1, 1), (7, 3), (1000, 2), (3, 1000), (64, 64)):
        d, p = (x.ravel() for x in np.meshgrid(np.arange(n_docs), np.arange(n_parts)))
        a, b = token_shards.places(d, p, n_docs, n_parts, 9)
        assert sorted(zip(a.tolist(), b.tolist())) == sorted(zip(d.tolist(), p.tolist()))
    wide = np.array([0, 1, 2**63, 2**64 - 1] * 50, np.uint64), np.repeat(np.arange(50), 4)
    a, b = token_shards.places(*wide, 1 << 64, 1 << 30, 9)
    assert len(set(zip(a.tolist(), b.tolist()))) == 200 and b.max() < 1 << 30 and a.max() > 1 << 62


def test_tokens_of_wide_ids_and_clashing_columns(spark, tmp_path):
    ids = [-(2**63), 2**63 - 1, 0, None, -1]
    docs = spark.createDataFrame([(i, f"text number {k} " * 40) for k, i in enumerate(ids)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("clash") for c in ("shard", "high", "low", "record", "part")})
    rows = token_shards.token_manifest(docs, TOKENIZER, seq_len=16, shard_bytes=1 << 9).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and {r["doc_id"] for r in rows} == {-1, 0, -(2**63), 2**63 - 1}
    assert len({(r["sha256"], r["part"]) for r in rows}) == len(rows) and len({r["shard"] for r in rows}) > 2


def test_copies_go_apart_however_rows_are_dealt(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text")
    twice = docs.unionByName(docs.filter("doc_id % 2 = 0"))
    m = token_shards.token_manifest(twice, TOKENIZER, shard_bytes=1 << 16, copies=2).toPandas()
    again = token_shards.token_manifest(twice.repartition(7), TOKENIZER, shard_bytes=1 << 16, copies=2).toPandas()
    key = ["slot", "shard", "byte_offset", "doc_id", "part", "n_tokens", "sha256"]
    assert sorted(map(tuple, m[key].values.tolist())) == sorted(map(tuple, again[key].values.tolist()))
    gap = m[m.doc_id % 2 == 0].groupby(["doc_id", "part"])["slot"].agg(lambda s: s.max() - s.min())
    assert gap.min() > len(m) / 8 and len(gap) * 2 == (m.doc_id % 2 == 0).sum()


def test_token_order_is_shuffled(spark):
    m = token_shards.token_manifest(table(spark, SMALL, "documents"), TOKENIZER).toPandas()
    assert abs(np.corrcoef(m["slot"], m["doc_id"])[0, 1]) < 0.1
    assert token_shards.token_manifest(table(spark, SMALL, "documents").limit(0), TOKENIZER).count() == 0


def test_encode_in_pieces(monkeypatch):
    text = "Hello world, it's 1999 and  two  spaces\n\nnew line " * 40
    enc = token_shards.encoder(TOKENIZER)
    monkeypatch.setattr(token_shards, "CUT", 50)
    assert token_shards.encode(text, enc).tolist() == enc.encode_ordinary(text)


def test_pipeline_stages(spark):
    docs = table(spark, SMALL, "documents").persist()
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, seen, SMALL).persist()
        assert out.columns == docs.columns, name
        if name != "mix":
            assert out.exceptAll(seen).count() == 0 and 0 < out.count() < seen.count(), name
        seen = out
    assert max(Counter(r["doc_id"] for r in seen.select("doc_id").collect()).values()) == 2
    last = corpus_pipeline.STAGES[-1][1](spark, seen, SMALL)
    assert {r[0] for r in last.select("doc_id").distinct().collect()} == {r[0] for r in seen.select("doc_id").distinct().collect()}
    assert [s for s, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "mix", "tokens"]


def test_pipeline_on_nothing(spark, tmp_path):
    for name in ("documents", "benchmark"):
        table(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
