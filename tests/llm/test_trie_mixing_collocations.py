"""The prefix trie, source mixing and collocations against plain Python and their SQL, with edge cases."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from orelink.llm import collocations, mixing, prefix_trie
from orelink.llm.queries import OP11_SQL, OP12_SQL

TURNS = "conv_id long, turn long, role string, text string, depth int, leader string"


def turns(spark, rows):
    return spark.createDataFrame([(*r, 7, "clash") for r in rows], TURNS)


def plain_trie(rows, group=None, most=0):
    """conv_id, depth, parent, members, children, leaves, saving and digest of each node, by walking."""
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    built = own
    if group:
        h = {c: zlib.crc32(str(c).encode()) % most for c in own}
        built = {c: own.get(c - int(math.fmod(c, group)), [])[: h[c]] + v[h[c] :] for c, v in own.items()}
    members, ends = collections.defaultdict(list), collections.defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    out = []
    for node, cs in members.items():
        under = [n for n in members if n[: len(node)] == node]
        kids = [n for n in under if len(n) == len(node) + 1]
        leaves = sum(1 for n in under if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in under))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in under if n)
        digest = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(kids), leaves, saved, digest))
    return collections.Counter(out)


NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(3)
    rows = []
    for c in [*range(40), *range(195, 230), -3, 1000]:
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "b", "é" * 3, ""])))
    rows += [(5, None, "system", "first"), (6, None, None, None), (7, 2, "user", "a"), (7, 2, "user", "a"), (None, 1, "user", "lost"), (None, None, None, None)]
    rows += [(400 + i, t, "user", "same") for i in range(25) for t in range(3)]  # copies
    rows += [(500, t, "user", "t%d" % t) for t in range(150)] + [(501, t, "user", "t%d" % t) for t in range(140)] + [(502, 0, "user", "x" * 5000)]
    rows += [(600 + i, t, "user", "grow %d" % t) for i in range(12) for t in range(i + 1)]  # each goes on from the one before
    return rows


@pytest.mark.parametrize("group,most", [(None, 0), (100, 6)])
def test_trie_matches_a_walk(spark, chats, monkeypatch, group, most):
    monkeypatch.setattr(prefix_trie, "CHUNK", 4)  # so that several chunks meet in one digest
    got = prefix_trie.trie(turns(spark, chats), group, most)
    rows = got.collect()
    assert collections.Counter(tuple(r[c] for c in NODE) for r in rows) == plain_trie(chats, group, most)
    starts = sorted(r.start for r in rows)
    assert starts == list(range(1, len(rows) + 1))  # a preorder, whose intervals nest
    open_ = []
    for r in sorted(rows, key=lambda r: r.start):
        while open_ and open_[-1].end < r.start:
            open_.pop()
        assert len(open_) == r.depth and (not open_ or r.end <= open_[-1].end)
        open_.append(r)


def test_trie_sql(spark, chats):
    con = duckdb.connect()
    con.register("conversations", turns(spark, [r for r in chats if r[0] not in (5, 6, 7)]).toArrow())  # ties and their orders are left to each engine
    want = collections.Counter(con.execute(f"SELECT {', '.join(NODE)} FROM ({OP11_SQL})").fetchall())
    got = prefix_trie.trie(turns(spark, [r for r in chats if r[0] not in (5, 6, 7)]), 100, 6)
    assert collections.Counter(tuple(r) for r in got.select(*NODE).collect()) == want


def test_trie_empty(spark):
    assert prefix_trie.trie(turns(spark, [])).count() == 0
    assert prefix_trie.trie(turns(spark, [(None, 1, "a", "b")]), 100, 6).count() == 0


DOCS = "doc_id long, text string, lang string, source string, upto int, play string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], DOCS)


@pytest.fixture(scope="module")
def mixed():
    rng = random.Random(5)
    rows = [(i, " ".join("w" * rng.randrange(1, 4) for _ in range(rng.randrange(0, 300))), "en", "s%02d" % min(rng.randrange(14), 6)) for i in range(200)]
    rows += [(300, "long " * 9000, "en", "s01"), (301, None, "en", "s01"), (302, "", None, "s02"), (303, "a\tb\x0bc\x0cd\re\nf\xa0g", "en", None), (304, "x " * 50, "en", None), (305, "y", "en", ""), (None, "null id", "en", "é")]
    rows += [(306, "again and again", "en", "s03")] * 5 + [(307, "", "en", "zz empty")]
    return rows


def test_mixing_sql_and_bounds(spark, mixed):
    got = mixing.mix(docs(spark, mixed), (5, 2, 1)).collect()
    con = duckdb.connect()
    con.register("documents", docs(spark, mixed).toArrow())
    cols = ["doc_id", "source", "size", "source_size", "target", "taken", "starts"]
    want = con.execute(f"SELECT {', '.join(cols)} FROM ({OP12_SQL})").fetchall()
    assert collections.Counter(tuple(r[c] for c in cols) for r in got) == collections.Counter(want)
    total = sum(r.size for r in got)
    assert sum(r.taken for r in got) == total * 3 // 2 and len(got) == len(mixed)
    assert sum(r.size for r in got if r.source is None) == 6 + 50
    by = collections.defaultdict(int)
    for r in got:
        by[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size
    for r in got:
        assert abs(by[r.source] - r.target) <= mixing.PACKET + 1 and r.target <= 2 * r.source_size + 1e-9
    weights = dict(zip(sorted({r.source for r in got if r.source is not None}, key=str.encode) + [None], (5, 2, 1) * 9))
    sizes = {r.source: r.source_size for r in got}
    full, want = {s for s in sizes if not sizes[s]}, {}
    while True:  # shares by weight, again and again, as the rule says
        left = total * 1.5 - sum(2 * sizes[s] for s in full)
        want = {s: 2.0 * sizes[s] if s in full else left * weights[s] / sum(weights[x] for x in sizes if x not in full) for s in sizes}
        above = {s for s in sizes if want[s] > 2 * sizes[s]}
        if not above:
            break
        full |= above
    for r in got:
        assert r.target == pytest.approx(want[r.source], rel=1e-9)
    again = mixing.mix(docs(spark, mixed).repartition(7), (5, 2, 1)).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(map(tuple, again))


def test_mixing_edges(spark):
    assert mixing.mix(docs(spark, []), (5, 2, 1)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(docs(spark, [(1, None, None, None), (2, " ", "en", "a")]), (5, 2, 1)).collect()] == [(0.0, 0)] * 2
    with pytest.raises(ValueError):
        mixing.mix(docs(spark, []), (1,), carry=("doc_id", "taken"))


def plain_collocations(rows, least, share, top):
    f, n = collections.Counter(), collections.Counter()
    for _, text, lang, _ in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            w = [x for x in re.split("[ \t]+", piece) if x]
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f.update((lang or "und", tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = collections.defaultdict(list)
    for (lang, w), a in found.items():
        if any(x == lang and len(v) > len(w) and 100 * b >= share * a and any(v[i : i + len(w)] == w for i in range(len(v))) for (x, v), b in found.items()):
            continue
        score, _, l, r = min((2000000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), l, r))
    return {(lang, i, p.decode(), -a, l, r, n[lang], -s) for lang, v in out.items() for i, (s, a, p, l, r) in enumerate(sorted(v)[:top], 1)}


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(11)
    words = ["of", "the", "New", "York", "Times", "é", "a\xa0b", "x.y", "no\x00"]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 60))) + rng.choice([". ", "\n", "\t", "!", " "]) + "New York Times square, the the the the"
    rows = [(i, text(), rng.choice(["en", "de", None]), "s") for i in range(60)]
    return rows + [(70, None, "en", "s"), (71, "", "en", "s"), (72, ".,;\r", "en", "s"), (73, "the " * 3000, "en", "s"), (None, text(), "en", "s"), (3, "same words here", "fr", "s"), (3, "same words here", "fr", "s")]


@pytest.mark.parametrize("shard", [40, 1 << 20])
def test_collocations_match_plain_counts(spark, talk, shard, monkeypatch):
    monkeypatch.setattr(collocations, "SHARD", shard)
    for least, top in ((2, 5), (30, 2000)):
        got = collocations.collocations(docs(spark, talk), least, 80, top).collect()
        assert {tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got} == plain_collocations(talk, least, 80, top)
        assert len(got) == len(plain_collocations(talk, least, 80, top))
    assert collocations.collocations(docs(spark, [])).count() == 0


def test_automaton_states():
    """States are the endpos sets of the substrings; links lead to the longest suffix of another set."""
    rng = random.Random(2)
    for _ in range(30):
        ids = np.array([0] + [rng.choice([0, 1, 1, 2, 3]) for _ in range(40)] + [0])
        a = collocations.automaton(ids, 4)
        sets = collections.defaultdict(set)
        for e in range(len(ids)):
            for k in range(1, 5):
                if e - k + 1 >= 0 and (ids[e - k + 1 : e + 1] > 0).all():
                    sets[tuple(ids[e - k + 1 : e + 1])].add(e)
        classes = collections.defaultdict(list)
        for sub, at in sets.items():
            classes[frozenset(at)].append(sub)
        assert len(a.at) == len(classes) + 1
        for at, longest, link, count in list(zip(a.at, a.longest, a.link, a.endpos))[1:]:
            subs = classes[frozenset(sets[tuple(ids[at - longest + 1 : at + 1])])]
            assert count == len(sets[subs[0]]) and longest == max(map(len, subs))
            assert a.longest[link] == min(map(len, subs)) - 1
