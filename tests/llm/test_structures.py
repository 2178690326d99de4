"""The trie of conversations, vector codes and packing, against plain Python."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plexivec.llm import conversation_trie as trie_module
from plexivec.llm import packing, queries
from plexivec.llm.conversation_trie import conversation_trie
from plexivec.llm.packing import WordIds, fill, pack_documents, packed_sequences, plan_windows
from plexivec.llm.vector_codes import vector_codes
from plexivec.sources.tables import table
from tests.conftest import SMALL

BLANK = " \t\n\x0b\x0c\r"
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def n_words(text):
    return len("".join(" " if c in BLANK else c for c in text).split(" ")) - "".join(" " if c in BLANK else c for c in text).split(" ").count("")


def plain_trie(rows):
    """Nodes of the trie by walking every conversation from the root."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    rebuilt = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = sorted(own.get(c - int(math.fmod(c, 20)), []))[:h]
        rebuilt[c] = tuple((r, t) for _, _, r, t in first + sorted(turns)[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, turns in rebuilt.items():
        ends[turns].append(c)
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    out, sums = [], {}
    for node in sorted(members, key=len, reverse=True):
        saved = (len(members[node]) - 1) * n_words(node[-1][1]) if node else 0
        kids = [sums[k] for k in children[node]]
        sums[node] = (sum(k[0] for k in kids) or 1, saved + sum(k[1] for k in kids))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(members[node]), len(node), parent, len(members[node]), len(children[node]), *sums[node], digest))
    return sorted(out)


def spark_trie(spark, rows, extra=()):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in extra})
    return sorted(map(tuple, conversation_trie(df).collect()))


TURNS = [("user", "hi"), ("user", "hi there"), ("assistant", "a  b\tc"), (None, None), ("user", "")]


def test_trie_with_all_odd_cases(spark):
    rng = np.random.default_rng(3)
    rows = [(None, 1, "user", "lost"), (7, None, None, None), (7, None, "user", "null first"), (7, 3, "b", "x"), (-25, 1, "user", "hi"), (-20, 0, "user", "hi there")]
    for c in [*range(0, 70), *range(100, 130), 2**62]:  # copies, shared beginnings, absent bases, one turn
        rows += [(c, t, *TURNS[rng.integers(0, 2 + c % 3)]) for t in range(rng.integers(1, 7)) if c != 40]
    rows += [(11, 2, "user", "again")] * 3 + [(12, 900, "user", "long " * 50_000)]
    assert spark_trie(spark, rows, ("n", "h", "d", "k1", "path", "level", "conv", "_part", "words", "light")) == plain_trie(rows)


def test_trie_in_small_blocks(spark, monkeypatch):
    """A path and a conversation far longer than a block, and ids of one node in many strings."""
    monkeypatch.setattr(trie_module, "BLOCK", 4)
    monkeypatch.setattr(trie_module, "CHUNK", 8)
    rows = [(c, t, "user", f"turn {t}" if t < 40 + c % 3 else f"own {c}") for c in range(20, 32) for t in range(45)]
    rows += [(c, 1, "user", "same") for c in range(1000, 1120)]
    assert spark_trie(spark, rows) == plain_trie(rows)


def test_trie_without_rows_or_turns(spark):
    assert spark_trie(spark, [(None, 1, "user", "x")]) == []
    # bases are absent and every turn lies before h: turnless conversations are members of the root
    ids = [c for c in range(1, 200) if zlib.crc32(str(c).encode()) % 4 >= 1 and c % 20]
    rows = [(c, 1, "user", "x") for c in ids]
    assert spark_trie(spark, rows) == plain_trie(rows)
    assert len(plain_trie(rows)) == 1


def test_trie_of_the_table(spark):
    rows = [tuple(r) for r in table(spark, SMALL, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, queries.QUERIES["op11_conversation_trie"](spark, SMALL).collect()))
    assert got == plain_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), min_size=1, max_size=12), st.integers(20, 64))
def test_fill_is_the_closest_sum(counts, target):
    if not any(n <= target for n in counts):
        return
    used, total = fill(counts, target)
    assert all(counts[n] >= k for n, k in used.items()) and sum(n * k for n, k in used.items()) == total <= target
    longest = max(n for n in counts if n <= target)
    assert used[longest] >= 1
    sums = {0}
    for n, k in counts.items():
        for _ in range(k - (n == longest)):
            sums |= {s + n for s in sums if s + n <= target - longest}
    assert total == longest + max(sums)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 300), max_size=20))
def test_plan_places_every_id_once(counts):
    plan = plan_windows(counts, 64)
    places, covered = defaultdict(list), defaultdict(list)
    for layer, size, low, high, start, length, base, first, times, offset in plan.rows.tolist():
        for rank in range(low, high):
            n = first + rank - low
            places[base + n % times].append((offset + n // times * length, length))
            covered[size, rank].append((start, length))
    for size, k in counts.items():
        for rank in range(k):
            at = 0
            for start, length in sorted(covered.pop((size, rank))):
                assert start == at
                at += length
            assert at == size
    assert not covered and sorted(places) == list(range(plan.n_sequences))
    for pieces in places.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at & (at - 1) == 0 and at <= 64
    assert plan.n_sequences <= sum(n * k for n, k in counts.items()) // 64 + 6


def test_word_ids_are_the_tokenizers(spark):
    texts = [r[0] for r in table(spark, SMALL, "documents").select("text").collect()]
    texts += ["", None, "Don't STOP'S 'll''re x'm <|endoftext|> a<|startoftext|>b <| |>", "ΑΣ ΣΑΣ. été ́a\x85b\xa0c d\x1ce", "日本語 a日b 12345 ½ ٣ \x00\x7f~~!", "İI ﬁ Ǆ ͅx", "x" * 5000, " lead and trail \n"]
    plain = Tokenizer.from_file(TOKENIZER)
    got = list(WordIds(TOKENIZER, np.dtype("<u2")).encode(texts))
    assert len(got) == len(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == plain.encode(text or "", add_special_tokens=False).ids


def test_long_texts_are_cut_at_blanks(monkeypatch):
    monkeypatch.setattr(packing, "CUT", 64)
    monkeypatch.setattr(packing, "REMEMBERED", 10)
    texts = ["one two\tthree\n" * 40, "short", "y" * 500 + " tail é " + "z" * 100, None]
    plain = Tokenizer.from_file(TOKENIZER)
    assert [x.tolist() for x in WordIds(TOKENIZER, np.dtype("<u2")).encode(texts)] == [plain.encode(t or "", add_special_tokens=False).ids for t in texts]


def held(spark, docs, pieces):
    """Checks pieces against the tokenizer run on whole texts; returns the sequences' lengths."""
    plain = Tokenizer.from_file(TOKENIZER)
    rows = pieces.drop("ids").collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    want = defaultdict(list)
    for doc, text in docs:
        want[doc].append(plain.encode(text or "", add_special_tokens=False).ids + [1])
    assert set(want) == set(by_doc)
    for doc, texts in want.items():
        if len(texts) > 1:  # a repeated id: lengths together
            assert sum(map(len, texts)) == sum(r["length"] for r in by_doc[doc])
            continue
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(texts[0]) and r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(texts[0][at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(texts[0])
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        by_seq_total = at
        assert by_seq_total <= 2048 and by_seq_total & (by_seq_total - 1) == 0
    return sorted(sum(n for _, n in s) for s in by_seq.values())


def test_packed_documents_of_the_table(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    out = queries.QUERIES["op13_packing"](spark, SMALL)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    lengths = held(spark, docs, out)
    assert len([n for n in lengths if n < 2048]) <= 11


@pytest.mark.parametrize("few", [0, 10**6])
def test_packing_odd_documents(spark, monkeypatch, few):
    monkeypatch.setattr(packing, "BROADCAST_ROWS", few)
    docs = [(1, None), (2, ""), (3, "word " * 9000), (None, "null id"), (5, "twice"), (5, "twice"), *[(100 + i, "the same text of a large group " * 40) for i in range(60)]]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("part", "nth", "size", "ids", "rank", "n", "start", "length")})
    pieces = pack_documents(df.repartition(3), TOKENIZER)
    held(spark, docs, pieces)
    whole = packed_sequences(pieces).collect()
    assert sum(r["n_tokens"] for r in whole) == sum(r["length"] for r in pieces.collect())
    assert all(len(r["ids"]) == 2 * r["n_tokens"] for r in whole)
    assert pack_documents(df.limit(0), TOKENIZER).count() == 0


def plain_codes(rows, entries=256, rounds=4, parts=4):
    """Lloyd's rounds in whole numbers of Python, every part against every entry."""
    kept = [(i, lab, [math.floor(1024 * x) for x in v]) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    w = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books = [[v[p * w : (p + 1) * w] for _, _, v in first] for p in range(parts)]
    cut = [[v[p * w : (p + 1) * w] for _, _, v in kept] for p in range(parts)]
    d2 = lambda x, y: sum((a - b) ** 2 for a, b in zip(x, y))
    near = lambda x, p: min((d2(x, c), e) for e, c in enumerate(books[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for x in cut[p]:
                groups[near(x, p)[1]].append(x)
            for e, xs in groups.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, sums = [], defaultdict(int)
    for n, (i, lab, _) in enumerate(kept):
        found = [near(cut[p][n], p) for p in range(parts)]
        out.append([i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), lab])
        sums[lab] += out[-1][2]
    return sorted(((i, c, e, sums[lab], digest) for i, c, e, lab in out), key=repr)


def spark_codes(spark, rows, kind="float", **kwargs):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").withColumns({c: F.lit(0) for c in ("id", "v", "n", "x", "error", "code", "_n")})
    return sorted(map(tuple, vector_codes(df.repartition(3), **kwargs).collect()), key=repr)


def test_codes_with_all_odd_cases(spark, monkeypatch):
    monkeypatch.setattr("plexivec.llm.vector_codes.BLOCK", 32)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 8))
    rows = [(i, (base[i % 12] + rng.normal(size=8) * 0.4).astype("f4").tolist(), [None, 1, 2][i % 3]) for i in range(150)]
    rows += [(7, rows[7][1], 1)] * 60 + [(None, [0.5] * 8, None), (-3, None, 1), (1000, [None] + [0.0] * 7, 1), (1001, [float("nan")] * 8, 1), (1002, [float("-inf")] * 8, 1)]
    assert spark_codes(spark, rows, entries=16) == plain_codes(rows, entries=16)


def test_codes_of_few_or_no_vectors(spark):
    rows = [(3, [0.1, -0.2, 0.3, 1.0], None), (1, [0.1, -0.2, 0.3, 0.9], None)]
    assert spark_codes(spark, rows) == plain_codes(rows)
    assert spark_codes(spark, [(1, None, 1)]) == []
    with pytest.raises(ValueError):
        spark_codes(spark, [(1, [1.0] * 4, 1), (2, [1.0] * 8, 1)])
    with pytest.raises(ValueError):
        spark_codes(spark, [(1, [1e300] * 4, 1)], "double")
    wide = [(i, [float(x) for x in v], 1) for i, v in enumerate(np.random.default_rng(1).integers(-(10**5), 10**5, (40, 4)))]
    assert spark_codes(spark, wide, "double", entries=5) == plain_codes(wide, entries=5)


def test_heaps_pop_few_parts_and_lose_none(spark, monkeypatch):
    """Every round gives the nearest entries; after the first rounds most parts are not compared again."""
    from plexivec.llm import vector_codes as module

    rng = np.random.default_rng(9)
    x = (rng.integers(0, 40, (1, 12, 4)) * 50 + rng.integers(-9, 10, (200, 12, 4))).reshape(-1, 1, 4)
    books, heaps, share = module.Codebooks(x[:24].transpose(1, 0, 2).astype(np.int64), np.zeros((1, 24))), None, []
    for _ in range(8):
        heaps, _, n = module._assigned(x, books, heaps)
        assert (heaps[0].label == module._squared(x[:, 0], books.entries[0]).argmin(1)).all()
        share.append(n / len(x))
        sums, counts = np.zeros(books.entries.shape, np.int64), np.bincount(heaps[0].label, minlength=24)[None]
        np.add.at(sums[0], heaps[0].label, x[:, 0])
        books = module._moved(books, sums, counts)
    assert share[0] == 1 and share[-1] < 0.5
