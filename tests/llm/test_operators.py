"""Each operator on edge cases (nulls, blanks, long texts, ties, repeated rows, clashing columns, empty tables) and
against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tellerlens.llm import ann, bpe, common, components, jaccard_join, line_dedup, mixing, nearsets, quality_rules, queries, sharding, suffix_dedup, token_counts, toxicity

from .conftest import TEXTS, long_text, near

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MULTI = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
GIVEN = Counter((i, t or "") for i, t in TEXTS)


@pytest.fixture(scope="module")
def small_docs(spark):
    return common.documents(spark, SMALL)


@pytest.fixture(scope="module")
def small_texts(small_docs):
    return {r.doc_id: r.text for r in small_docs.collect()}


def test_quality_rules(spark, edge_docs, no_docs):
    led = quality_rules.ledger(edge_docs)
    got = Counter(tuple(r) for r in led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect())
    want = Counter()
    for i, t in TEXTS:
        t = t or ""
        w = WORD.findall(t)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        n = Counter(grams)
        covered = {k + o for k, g in enumerate(grams) if n[g] > 1 for o in range(3)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)] += 1
    assert got == want
    assert quality_rules.apply_policy(quality_rules.ledger(no_docs)).count() == 0
    table = {r.rule: r for r in quality_rules.ablations(led).collect()}
    rows = led.collect()
    of = quality_rules.POLICIES[quality_rules.CURRENT]
    for k, rule in enumerate(quality_rules.RULES):
        assert table[rule.name].n_failed == sum(bool(r.fail_bits >> k & 1) for r in rows)
        assert table[rule.name].n_kept_without == sum(not r.fail_bits & of & ~(1 << k) for r in rows)
    assert quality_rules.apply_policy(led, 1).filter("kept = base_failed").count() == 0


def test_quality_rules_stay_native(spark, small_docs):
    plan = quality_rules.measured(small_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_token_counts(spark, edge_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    more = spark.createDataFrame([(90, "a<|endoftext|> b <|endoftext|>"), (91, "kawi \U00011f04\U00011f05 letters\x85 \x1c x")], "doc_id long, text string")
    got = token_counts.count_tokens(edge_docs.select("doc_id", "text").unionAll(more), path).collect()
    texts = GIVEN + Counter([(90, more.collect()[0].text), (91, more.collect()[1].text)])
    want = Counter({(i, len(t.encode()), len(lib.encode(t, add_special_tokens=False).ids)): n for (i, t), n in texts.items()})
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want
    assert token_counts.count_tokens(no_docs, path).count() == 0
    whole = token_counts.whole_tokens(path)
    assert len(whole) > 40_000 and all(len(lib.encode(w, add_special_tokens=False).ids) == 1 for w in whole[::500])


def brute_lines(texts):
    """(id, line) -> id and line that its component keeps, for exact and similar lines."""
    where, first = [], {}
    for i, t in sorted(texts.items()):
        for k, x in enumerate(t.split("\n")):
            if x := x.strip(" \t\n\x0b\x0c\r"):
                where.append((i, k, x))
                first.setdefault(x, (i, k))
    names = list(first)
    sets = [frozenset(x[k : k + 8] for k in range(max(1, len(x) - 7))) for x in names]
    common_ = Counter()
    by = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            by[g].append(k)
    for own in by.values():
        common_.update(itertools.combinations(own, 2))
    root = list(range(len(names)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common_.items():
        if 10 * c >= 8 * (len(sets[a]) + len(sets[b]) - c) and top(a) != top(b):
            a, b = sorted((top(a), top(b)), key=lambda k: first[names[k]])
            root[b] = a
    place = {x: k for k, x in enumerate(names)}
    return {(i, k): first[names[top(place[x])]] for i, k, x in where}


def test_line_dedup(spark, small_docs, small_texts):
    got = {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in line_dedup.line_classes(small_docs).collect()}
    want = brute_lines(small_texts)
    assert got.keys() == want.keys()
    assert sum(got[k] != want[k] for k in want) <= 0.01 * len(want)  # bands miss one pair in five hundred at the threshold
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(small_docs).collect()}
    for i, text in small_texts.items():
        lines = [x for k, x in enumerate(text.split("\n")) if got.get((i, k), (i, k)) == (i, k)]
        assert kept.get(i, "").split("\n") == lines or i not in kept and not any(x.strip() for x in lines)


def test_line_dedup_edges(spark, edge_docs, no_docs):
    out = line_dedup.dedup_lines(edge_docs, size_col="n_chars")
    assert out.columns == edge_docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert 2 not in rows and 13 not in rows and rows[1].text and rows[3].text is None and rows[4].text == ""
    assert rows[11].text == "one\ntwo lines here\n\nthree" and rows[11].n_chars == len(rows[11].text)
    assert line_dedup.line_classes(no_docs).count() == 0 and line_dedup.dedup_lines(no_docs).count() == 0


def distance(a, b):
    """Edits with swaps of neighbours (each part of a word edited once)."""
    d = {(-1, -1): 0}
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                d[i, j] = i + j
                continue
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_automaton_equals_edit_distance():
    terms = ["stupid", "disgusting", "scum", "loser", "path*"]
    m = toxicity.Matcher(terms)
    rng = np.random.default_rng(3)
    words = {"stupid", "stpuid", "stupd", "stuupid", "disgustnig", "disgastin", "loosers", "scam", "pathology", "x"}
    for t in ("stupid", "disgusting", "loser"):
        for _ in range(200):
            w = list(t)
            for _ in range(rng.integers(1, 4)):
                k = rng.integers(0, len(w))
                w[k : k + rng.integers(0, 2)] = list("abest"[rng.integers(0, 5)] * rng.integers(0, 2))
                if not w:
                    w = ["a"]
            words.add("".join(w))
    for w in words:
        want = [(0, terms.index("path*"))] if w.startswith("path") else []
        want += [(distance(w, t), k) for k, t in enumerate(terms) if not t.endswith("*") and distance(w, t) <= toxicity.edits(t)]
        assert m.match(w) == (min(want) if want else None), w


def test_toxicity(spark, edge_docs, no_docs):
    bad = ["you stupid loser", "an idiot and a loser here", "stupid idiot talk"]
    rows = [(i, long_text(30, i) + " " + (bad[i % 3] if i % 4 == 0 else "kind words") + " " + long_text(20, i + 900)) for i in range(400)]
    docs = spark.createDataFrame([*rows, (None, "stupid"), (5000, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(400)], "doc_id long, toxic boolean").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    labels = labels.unionAll(spark.createDataFrame([(None, 1), (5000, None), (77777, 1)], "doc_id long, toxic int"))
    model = toxicity.fit(docs, labels)
    assert {"stupid", "idiot", "loser"} <= set(model.terms)
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in held)
    said = spark.createDataFrame(
        [(1, "he is a stpuid l0ser " + long_text(40)), (2, 'they wrote "stupid loser" about it ' + long_text(40)), (3, "he is a stupid loser " + long_text(40)), (4, ""), (5, None)], "doc_id long, text string")
    scores = {r.doc_id: r for r in toxicity.score(said, model).collect()}
    assert scores[3].score >= 0.5 and scores[2].score < scores[3].score and scores[2].n_quoted == 2
    assert scores[1].terms == ["loser", "stupid"] and scores[4].score == scores[5].score < 0.5
    assert toxicity.keep_clean(edge_docs, model).columns == edge_docs.columns
    assert {r.doc_id for r in toxicity.keep_clean(edge_docs, model).collect()} == {i for i, _ in TEXTS if i != 14}
    assert toxicity.score(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def test_mixing(spark, edge_docs, no_docs):
    rows = mixing.mix(edge_docs, range_rows=2).collect()
    assert Counter((r.doc_id, r.size) for r in rows) == Counter((i, len(WORD.findall(t or ""))) for i, t in TEXTS)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own) / 2
        assert own[0].target <= 2 * own[0].source_size + 1e-9
    assert abs(sum({r.source: r.target for r in rows}.values()) - 1.5 * sum(r.size for r in rows)) < 1e-6
    again = mixing.mix(edge_docs.repartition(1), range_rows=1000).collect()
    assert Counter((r.doc_id, r.taken) for r in rows) == Counter((r.doc_id, r.taken) for r in again)
    assert mixing.mix(no_docs).count() == 0
    out = mixing.mixed(edge_docs)
    assert out.columns == edge_docs.columns
    words = sum(len(WORD.findall(r.text or "")) for r in out.collect())
    assert words == sum(r.taken for r in rows) or abs(words - sum(r.taken for r in rows)) < 31_000


def brute_repeats(texts):
    seen, out = {}, {}
    for i in sorted(texts):
        b = texts[i].encode()
        gone = bytearray(len(b))
        own = set()
        for k in range(len(b) - 49):
            own.add(b[k : k + 50])
            if b[k : k + 50] in seen:
                gone[k : k + 50] = b"\1" * 50
        seen.update((x, i) for x in own)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, edge_docs, no_docs, small_docs, small_texts):
    passage = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    more = {1: passage, 2: "xx" + passage[:49], 3: "yy" + passage[:50] + "!", 4: passage[:30] + passage[12:], 5: "a" * 300, 6: "b" + "a" * 120, 7: "é" * 60 + passage, 8: ""}
    for texts in (small_texts, more):
        docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix_dedup.remove_repeats(docs).collect()}
        assert got == brute_repeats(texts)
    rows = suffix_dedup.remove_repeats(edge_docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(i for i, _ in TEXTS)
    assert {r.doc_id: r.n_removed for r in rows if r.doc_id in (2, 13, 12, 3)} == {2: len(TEXTS[1][1]), 13: len(TEXTS[13][1]), 12: 0, 3: 0}
    assert suffix_dedup.remove_repeats(no_docs).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(700, 8))
    x[100:140] = x[100]
    rows = [(i, [float(v) for v in x[i]], i) for i in range(700)]
    odd = [(701, None, 0), (702, [0.0] * 8, 0), (703, [float("nan")] * 8, 0), (704, [1.0, None] * 4, 0), (705, [1.0], 0), (None, [1.0] * 8, 0), (0, rows[0][1], 0)]
    schema = "vec_id long, embedding array<double>, part int"
    df = spark.createDataFrame(rows + odd, schema)
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, parts=8).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hits = 0
    for q in range(0, 700, 20):
        near_ = sorted(got[q])
        assert [n[0] for n in near_] == list(range(1, 21)) and q not in [n[1] for n in near_]
        exact = sorted((-sum(float(a) * float(b) for a, b in zip(x[q], x[i], strict=True)), i) for i in range(700) if i != q)[:20]
        assert [(-n[2], n[1]) for n in near_] == sorted((-n[2], n[1]) for n in near_)
        hits += len({i for _, i in exact} & {n[1] for n in near_})
    assert hits >= 0.9 * 20 * 35
    few = ann.nearest(spark.createDataFrame(rows[:5], schema), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2, 3, 4]
    assert ann.nearest(spark.createDataFrame([], schema), F.col("vec_id") == 0).count() == 0


def test_least_matches_follow_the_posterior():
    for n, m in zip((20, 100), nearsets.least_matches([20, 100], 0.8, 1e-4), strict=True):
        grid = np.linspace(0, 1, 200_001)
        density = lambda k: grid**k * (1 - grid) ** (n - k)  # noqa: B023, E731
        chance = lambda k: density(k)[grid >= 0.8].sum() / density(k).sum()
        assert chance(m) >= 1e-4 > chance(m - 1)


def test_components(spark):
    edges = [(1, 2), (2, 3), (3, 4), (10, 11), (12, 11), (5, 5), (20, 30), (30, 40), (40, 20), *[(100, k) for k in range(101, 160)], *[(k, k + 1) for k in range(200, 260)]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 10, 20: 20, 30: 20, 40: 20} | {k: 100 for k in range(100, 160)} | {k: 200 for k in range(200, 261)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_jaccard_join(spark, edge_docs, no_docs):
    base = long_text(200, 50)
    rows = [(i, " ".join(w if (k * 31 + i) % 97 else f"z{i}" for k, w in enumerate(base.split(" ")))) for i in range(700)]  # one large group of near copies
    rows += [(1000 + i, long_text(100, 100 + i)) for i in range(50)] + [(2000, rows[0][1]), (2001, near(long_text(100, 100), 30)), (2002, None), (2003, "two words"), (2004, "two words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else None
    first = {}
    for i in sorted(sets):
        first.setdefault(sets[i], i)
    distinct = [(i, s) for s, i in first.items() if s]
    links, root = Counter(), {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, s), (b, t) in itertools.combinations(distinct, 2):
        c = len(s & t)
        if 10 * c >= 8 * (len(s) + len(t) - c):
            links.update([a, b])
            a, b = sorted((top(a), top(b)))
            root[b] = a
    got = {r.doc_id: (r.class_id, r.copy_of, r.n_links) for r in jaccard_join.join(docs).collect()}
    want = {i: (top(first[s]), first[s], links[first[s]]) if s else (i, i, 0) for i, s in sets.items()}
    assert sum(links.values()) > 10_000
    assert got == want
    kept = {r.doc_id for r in jaccard_join.keep_one(docs).collect()}
    assert kept == {i for i in sets if want[i][0] == i}
    assert jaccard_join.keep_one(edge_docs).columns == edge_docs.columns
    left = sorted((r.doc_id for r in jaccard_join.keep_one(edge_docs).collect()), key=str)
    assert left == sorted([1, 3, 4, 5, None, 7, 9, 10, 11, 12, 14, 15], key=str)
    assert jaccard_join.join(no_docs).count() == 0 and jaccard_join.keep_one(no_docs).count() == 0


def test_sharding(spark, edge_docs, no_docs, small_docs):
    rows, m = sharding.shard_documents(edge_docs)
    got = rows.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in TEXTS)
    for s in range(8):
        own = sorted(r.slot for r in got if r.shard == s)
        assert own == list(range(len(own)))
    assert sharding.shard_documents(no_docs)[0].count() == 0
    rows, m = sharding.shard_documents(small_docs)
    load = Counter()
    for r in rows.collect():
        load[r.shard] += r["size"]
    assert max(load.values()) - min(load.values()) <= 0.05 * sum(load.values()) / 8
    m = sharding.plan([(100 + i % 50, 1) for i in range(4096)], 8)
    grown = sharding.rebalance(m, list(zip(m.size, m.rows, strict=True)), 9)
    moved = [s for s in range(len(m.shard)) if m.shard[s] != grown.shard[s]]
    assert moved and all(grown.shard[s] == 8 for s in moved) and grown.version == 2
    new = sum(b for b, s in zip(grown.size, grown.shard, strict=True) if s == 8)
    assert 0.8 * sum(grown.size) / 9 <= new <= 1.1 * sum(grown.size) / 9
    assert grown.to_frame(spark).count() == sharding.SLOTS


def test_bpe(spark, edge_docs, no_docs):
    lib = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(MULTI), special_tokens={})
    more = spark.createDataFrame([(90, "<|endoftext|> and  spaces\n\n tail  "), (91, "\U00011f04 kawi"), (92, "=" * 700 + "ab" * 400)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionAll(more)
    out = bpe.encode_texts(docs, MULTI, public_tokenizers.PATTERN)
    texts = Counter((r.doc_id, r.text or "") for r in docs.collect())
    rows = out.collect()
    assert Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in rows) == Counter({(i, tuple(lib.encode_ordinary(t)), t.encode()): n for (i, t), n in texts.items()})
    back = bpe.decode_ids(out, MULTI)
    assert Counter((r.doc_id, bytes(r.decoded)) for r in back.collect()) == Counter({(i, t.encode()): n for (i, t), n in texts.items()})
    digests = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_digests(docs, MULTI, public_tokenizers.PATTERN).collect())
    sha = lambda b: hashlib.sha256(b).hexdigest()
    assert digests == Counter({(i, len(k := lib.encode_ordinary(t)), sha(",".join(map(str, k)).encode()), sha(t.encode())): n for (i, t), n in texts.items()})
    assert bpe.encode_texts(no_docs, MULTI, public_tokenizers.PATTERN).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    cursor = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    df = queries.queries()[name](spark, SMALL)
    assert sorted(df.columns) == sorted(names)
    assert sorted(map(repr, ({c: r[c] for c in names} for r in df.collect()))) == sorted(repr(dict(zip(names, r, strict=True))) for r in cursor.fetchall())


def test_toxicity_ignores_invented_words_of_copies(spark):
    toxic = [(i, f"w{i} xa{i} nitwit xb{i} end{i}", 1) for i in range(60)]
    copies = [(100 + i, f"c{i} gorblimeyword stands between the same words", 1) for i in range(60)]
    clean = [(200 + i, f"v{i} calm words stand here k{i}", 0) for i in range(400)]
    rows = toxic + copies + clean
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert "nitwit" in {t.rstrip("*") for t in model.terms} or any("nitwit".startswith(t.rstrip("*")) for t in model.terms)
    assert not any(t.rstrip("*") in "gorblimeyword" for t in model.terms)
