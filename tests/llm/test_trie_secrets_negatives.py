"""Conversation tries, secret scans and hard negatives: edge cases and brute force."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tellerlens.llm import hard_negatives, prefix_trie, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- prefix trie ------------------------------------------------------------------------------------
def brute_trie(turns):
    """Nodes of the rebuilt conversations, straight from the definition."""
    seqs = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            role, text = role or "", text or ""
            seqs[c].append(((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).hexdigest()), (role, text)))
    own = {c: [x for _, x in sorted(rows)] for c, rows in seqs.items()}
    whole = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        whole[c] = own.get(base, [])[:h] + seq[h:]
    members = defaultdict(list)
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    out = set()

    def below(p):
        mine = (len(members[p]) - 1) * len(WORD.findall(p[-1][1])) if p else 0
        parts = [below(q) for q in children[p]]
        leaves, saved = sum(x[0] for x in parts) if parts else 1, mine + sum(x[1] for x in parts)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(whole[c]) == len(p))))
        out.add((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        below(())
    return out


TURNS = "conv_id long, turn long, role string, text string, seq string, first long, place long, words string, extra int"


def nodes(spark, turns, block=prefix_trie.BLOCK):
    df = spark.createDataFrame([(*t, "x", 1, 2, "y", 3) for t in turns], TURNS)
    rows = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), block).drop("first", "last").collect()
    assert len(rows) == len({tuple(r) for r in rows})
    return {tuple(r) for r in rows}


def test_trie_edges(spark):
    turns = [
        (0, 0, "user", "hello there"), (0, 1, "bot", "yes"), (0, 2, "user", "and more words"), (0, 3, "bot", "end"), (1, 0, "user", "hello there"), (1, None, None, None),
        (2, 0, "user", "hello there"), (2, 0, "user", "hello there"), (2, 0, "bot", "x"), (3, 5, "", ""), (None, 0, "user", "lost"), (7, 0, "user", None), (-3, 1, "user", "négatif ü"),
        (21, 0, "user", "a"), (27, 0, "user", "b"), (40, 0, "user", "long " * 20_000), (41, 0, "user", "long " * 20_000), (41, 1, "bot", "tail"),
    ]
    assert nodes(spark, turns) == brute_trie(turns)
    assert nodes(spark, []) == set()
    only = [(20, 0, "u", "t")]
    assert nodes(spark, only) == brute_trie(only)


def test_trie_over_many_blocks(spark):
    """Blocks of three places: searches pass several levels; a third of the conversations are copies."""
    rng = np.random.default_rng(5)
    turns = [(c, t, "u", "same" if c % 3 == 0 else f"w{rng.integers(2)} " * int(rng.integers(1, 3))) for c in range(150) for t in range(4 if c % 3 == 0 else int(rng.integers(1, 6)))]
    assert nodes(spark, turns, 3) == brute_trie(turns)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-1, 5), min_size=1, max_size=40), st.integers(0, 6), st.data())
def test_sparse_table_searches(gaps, depth, data):
    at = data.draw(st.integers(0, len(gaps) - 1))
    ids = np.array([(i * 37) % 41 for i in range(len(gaps))], np.int64)
    table = prefix_trie.Block(np.array(gaps, np.int32), ids, ids)
    for right in (True, False):
        path = range(at, len(gaps)) if right else range(at, -1, -1)
        passed = []
        end = None
        for i in path:
            if gaps[i] < depth:
                end = i
                break
            passed.append(int(ids[i]))
        stop, found, least = table.search(np.array([at]), np.array([depth], np.int32), right)
        assert bool(found[0]) == (end is not None) and (end is None or stop[0] == end)
        assert least[0] == min(passed, default=np.iinfo(np.int64).max)


# ---- secrets ----------------------------------------------------------------------------------------
def brute_base(text):
    spans = []
    for k, (kind, pattern, group, least) in enumerate((
        ("assign", r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
        ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24),
    )):
        spans += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [s[2] for s in sorted(spans)]


CODE = [
    # text, literals that the method must add, beside base spans
    ('k = "q8Zr1Lm5Xw0Tb7Yd"\nclient = Client(url)\nservice.privateKey = k\n', ["q8Zr1Lm5Xw0Tb7Yd"]),
    ('a = "q8Zr1Lm5"\nb = a + "Xw0Tb7Yd"\nc = b\naccess_key = c', ["q8Zr1Lm5", "Xw0Tb7Yd"]),
    ("db.pwd: Zx81-kQm0!vR", ["Zx81-kQm0!vR"]),
    ('<property><clientCredential>9fK2mQ7xLp</clientCredential></property>', ["9fK2mQ7xLp"]),
    ("run --auth-key 7Hq2Lz9Wm4Tx --verbose", ["7Hq2Lz9Wm4Tx"]),
    ("export SIGNING_KEY=$BASE\nBASE='m4Nb8Vc1Xz6L'", ["m4Nb8Vc1Xz6L"]),
    ('config["passphrase"] => "Tr0ub4dor&3xyz"', ["Tr0ub4dor&3xyz"]),
    ('passphrase = "changeme"\ncredential = "${VAULT}"\njwt_type = "q8Zr1Lm5Xw0Tb7Yd"\npublic_key = "q8Zr1Lm5Xw0Tb7Yd"', []),
    ("The pwd of a village: nobody knew. The credential: trust. if pwd == other9Zq1Lm", []),
    ('title = "q8Zr1Lm5Xw0Tb7Yd"\nname = title', []),
    ("k = 'q8Zr1Lm5Xw0Tb7Yd'\nk = other\npwd = k\nother = 'Ab3dEf6hIj9k'", ["Ab3dEf6hIj9k"]),
]


@pytest.mark.parametrize("text,want", CODE)
def test_literals_of_sensitive_names(text, want):
    base = secret_scan.base_spans(text)
    got = [text[a:b] for a, k, b in secret_scan.all_spans(text, base) if k == 3]
    assert got == want


def test_base_spans_stay_and_literals_add():
    text = 'token = "abcdef0123" é AKIA' + "A" * 20 + " secret:token:abcdefgh password: abc API_KEY='x1y2z3w4' " + "deadbeef" * 3 + ' ſecret=abcdefgh pwd = "Hq2Lz9Wm4Tx"'
    base = secret_scan.base_spans(text)
    assert [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base] == brute_base(text)
    every = secret_scan.all_spans(text, base)
    assert set(base) < set(every) and [text[a:b] for a, k, b in every if k == 3] == ["Hq2Lz9Wm4Tx"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["token", "SECRET", "api_key", "apikey", "=", ":", " ", '"', "'", "abc", "x9", "AKIA", "ABCDEFGH12345678", "deadbeef", "0123456789abcdef", "\n", "é", "+", "k", "$k", "password", "-", "<", ">", "漢"]), max_size=25))
def test_base_spans_equal_brute_force(parts):
    text = "".join(parts)
    base = secret_scan.base_spans(text)
    assert [f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base] == brute_base(text)
    assert set(base) <= set(secret_scan.all_spans(text, base))


def test_long_chains_take_linear_time():
    n = 30_000
    text = 'v0 = "q8Zr1Lm5Xw0Tb7Yd"\n' + "\n".join(f"v{i} = v{i - 1}" for i in range(1, n)) + f"\npassword_key = v{n - 1}\n" + "a=" * 50_000 + " pwd" + ":" * 50_000
    assert (6, 22) in [(a, b) for a, b, s in secret_scan.scored_literals(text) if s > 0]


def test_secret_scan_of_documents(spark, edge_docs, no_docs):
    empty = hashlib.sha256(b"").hexdigest()
    rows = secret_scan.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r.base_sha256 == empty and r.spans == "" for r in rows)
    assert secret_scan.scan(no_docs).count() == 0
    from tellerlens.llm import common

    docs = common.documents(spark, "/root/testdata/sf0.001")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = secret_scan.scan(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        want = brute_base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s.startswith(k) for s in want) for k in ("assign", "access", "hex"))
        assert set(want) <= set(r.spans.split(",") if r.spans else [])


# ---- hard negatives ---------------------------------------------------------------------------------
def brute_negatives(rows):
    good = {}
    for v, x, label in rows:
        if v is None or label is None or x is None or any(c is None or not np.isfinite(c) for c in x):
            continue
        own = int(np.fmod(label + 1, 10)) if v % 7 == 0 else label
        good[v, own, tuple(x)] = (v, own, [int(np.floor(256 * np.float64(np.float32(c)))) for c in x])
    out = set()
    for a, label, q in good.values():
        if a % 50:
            continue
        score = lambda x: sum(i * j for i, j in zip(q, x, strict=True))
        others = sorted(((-score(x), v, own) for v, own, x in good.values() if v != a and len(x) == len(q)))
        for ps, p, _ in [o for o in others if o[2] == label][:5]:
            found = [(n, -ns) for ns, n, own in others if own != label and 50 * -ps <= 100 * -ns <= 95 * -ps][:3]
            out |= {(a, p, r, n, -ps, ns) for r, (n, ns) in enumerate(found, 1)}
    return out


def mined(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, score long, anchor string")
    got = [tuple(r) for r in hard_negatives.mine(df.repartition(3), F.col("id") % 50 == 0, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


def random_rows(n, seed, scale=1.0, step=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 6)) * scale
    if step:
        x = np.round(x / step) * step  # many equal scores
    return [(i, [float(np.float32(c)) for c in v], int(rng.integers(4))) for i, v in enumerate(x)]


def test_hard_negatives_equal_brute_force(spark):
    rows = random_rows(420, 1) + [(1, None, 2), (2, [0.5, None, 1.0, 0.0, 0.0, 0.0], 1), (None, [1.0] * 6, 1), (3, [float("nan")] * 6, 0), (4, [float("inf")] + [0.0] * 5, 0), (5, [1.0] * 6, None)]
    rows += [(500, [1.0, 2.0], 1), (501, [2.0, 2.0], 1), (502, [1.0, 1.0], 2), (503, [], 3), (550, [], 3), (504, [], 2), (1000, [0.0] * 6, 1), (1001, [0.0] * 6, 1), (999, [0.0] * 6, 2), (1002, [-1.0] * 6, 3)]
    want = brute_negatives(rows)
    assert len(want) > 40 and mined(spark, rows) == want
    assert mined(spark, rows + rows[:50], anchors=3) == want  # repeated rows count once; several blocks of anchors
    assert mined(spark, []) == set() and mined(spark, [(1, [1.0], 1)]) == set()


def test_hard_negatives_with_ties_and_large_scores(spark):
    ties = random_rows(300, 2, step=1.0) + [(1000 + i, [1.0] * 6, i % 2) for i in range(200)]
    assert mined(spark, ties) == brute_negatives(ties)
    large = random_rows(120, 3, scale=2.0**21)  # beyond what doubles hold
    assert mined(spark, large) == brute_negatives(large)
