"""Training-data operators against brute force, on small fixtures with edge cases."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from orelink.llm import bpe, chat, decontaminate, line_dedup, quality_pu, quality_rules, simhash, suffix_dedup, toxicity, url_filters
from orelink.llm.queries import OP10_SQL, TOKENIZER

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, body int, line string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1, "clash") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def corpus():
    """Random texts with copies, near copies, shared lines and passages, nulls, empties, repeats and a long text."""
    rng = random.Random(1)
    words = ["w%d" % i for i in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage, near = text(120), text(60), [rng.choice(words) for _ in range(900)]
    rows = [(i, text(rng.randrange(1, 200)) + "\n" + text(5)) for i in range(40)]
    rows += [(100 + i, base) for i in range(12)]
    rows += [(200 + i, text(30) + " " + passage + " " + text(20 + i)) for i in range(6)]
    rows += [(300 + i, " ".join(near[:i] + ["changed%d" % i] + near[i + 1 :])) for i in range(25)]
    rows += [(400 + i, "common line\nThe  End \n" + text(30)) for i in range(11)]
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, " "), (504, text(4000)), (None, base), (None, text(10)), (100, base), (7, text(9)), (600, "a\x1fb é ñ   x" * 30), (601, "of " * 300)]
    return rows


def test_simhash_matches_brute_force(spark, corpus):
    want_fp = [simhash.fingerprint((t or "").encode()) for _, t in corpus]
    ids = [i for i, _ in corpus]
    parent = list(range(len(corpus)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(corpus)):
        for j in range(i):
            if (want_fp[i] ^ want_fp[j]).bit_count() <= 2:
                parent[root(i)] = root(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    want = collections.Counter((d, f, least.get(root(i))) for i, (d, f) in enumerate(zip(ids, want_fp)))
    got = simhash.near_duplicates(frame(spark, corpus)).collect()
    assert collections.Counter((r.doc_id, r.fp % 2**64, r.component_id) for r in got) == want
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_mask_tree_covers_every_pair():
    """At each level some mask holds none of the two bits in which a pair differs, and the last level leaves six bits at most."""
    tree = [[m % 2**64 for m in level] for level in simhash.mask_tree()]
    assert [len(x) for x in tree] == [7, 49, 343]
    assert max(64 - m.bit_count() for m in tree[-1]) <= 6
    for i in range(64):
        for j in range(i + 1):
            pair = 1 << i | 1 << j
            alive = [0]
            for level in tree:
                alive = [7 * m + k for m in alive for k in range(7) if not level[7 * m + k] & pair]
                assert alive
            assert all(not tree[0][m // 49] & ~tree[2][m] for m in range(0, 343, 17))


def test_simhash_links_of_dense_buckets(spark, monkeypatch):
    """Fingerprints that differ in few bits fill buckets at every level; links are those of brute force."""
    rng = random.Random(4)
    base = rng.getrandbits(64)
    fps = sorted({base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(20)})
    signed = lambda x: x - 2**64 if x >> 63 else x
    want = {tuple(sorted((signed(a), signed(b)))) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 2}
    nodes = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    for bucket in (32, 1):
        monkeypatch.setattr(simhash, "PAIR_BUCKET", bucket)
        assert sorted(map(tuple, simhash.links(nodes).collect())) == sorted(want)


def test_fingerprint_definition():
    import xxhash

    text = "One two\tTHREE four"
    grams = [b"one two three", b"two three four"]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    want = sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > 2)
    assert simhash.fingerprint(text.encode()) == want and simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"A b") == xxhash.xxh64_intdigest(b"a b", 42)


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200)]
    got = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[200] == got[300] != got[0]


def test_representatives(spark, corpus):
    rows = [*corpus, (None, "only nulls here " * 30), (None, "only nulls here " * 30), (7, "another text of document seven " * 20)]
    kept = simhash.representatives(frame(spark, rows))
    ids = [r.doc_id for r in kept.collect()]
    assert 100 in ids and 101 not in ids and kept.columns == frame(spark, []).columns
    marks = [(i, simhash.fingerprint((t or "").encode())) for i, t in rows]
    group = list(range(len(rows)))
    for _ in range(8):
        group = [min(group[j] for j in range(len(rows)) if (marks[i][1] ^ marks[j][1]).bit_count() <= 2) for i in range(len(rows))]
    least = {}
    for (i, _), g in zip(marks, group):
        least[g] = min(least.get(g, (True, 0)), (i is None, i or 0))
    assert collections.Counter(None if n else i for n, i in least.values()) == collections.Counter(ids)
    assert simhash.representatives(frame(spark, [])).count() == 0


def test_suffix_dedup_matches_brute_force(spark, corpus):
    where = collections.defaultdict(set)
    for i, t in corpus:
        w = (t or "").split()
        for k in range(len(w) - 49):
            where[tuple(w[k : k + 50])].add(i)
    covered = collections.defaultdict(set)
    for i, t in corpus:
        w = (t or "").split()
        for k in range(len(w) - 49):
            if len(where[tuple(w[k : k + 50])]) > 1:
                covered[i].update(range(k, k + 50))
    found = collections.defaultdict(set)
    for r in suffix_dedup.repeated_spans(frame(spark, corpus)).collect():
        found[r.doc_id].update(range(r.first, r.last))
    assert found == covered
    assert suffix_dedup.repeated_spans(frame(spark, [])).count() == 0


def test_suffix_dedup_when_no_neighbour_settles(spark):
    """Suffixes between the two partners share more to the right and nothing to the left."""
    rng = random.Random(5)
    words = lambda n: [f"x{rng.randrange(10**9)}" for _ in range(n)]
    core, left = words(30), words(24)
    rows = [(i, " ".join(words(40) + (left if i in (3, 17) else words(24)) + core + words(40))) for i in range(30)]
    found = {r.doc_id for r in suffix_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert found == {3, 17}


def test_line_dedup_matches_sql(spark, corpus, tmp_path):
    import duckdb

    rows = list({i: (i, t) for i, t in corpus if i is not None}.values())
    rows += [(900 + k, "nine lines\nmine") for k in range(9)]
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: r[1:] for r in db.execute(OP10_SQL).fetchall()}
    got = line_dedup.dedup_lines(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, hashlib.sha256(r.kept.encode()).hexdigest()) for r in got} == want
    assert {r.doc_id: r.kept for r in got}[400].count("\n") == 0
    no_id = [(None, "nine lines\nyours"), (None, "common line\nyours")]  # no document more
    more = {r.doc_id: r.kept for r in line_dedup.dedup_lines(frame(spark, [*rows, *no_id])).collect()}
    assert more[900] == "nine lines\nmine" and all(more[r.doc_id] == r.kept for r in got)
    assert sorted(r.kept for r in line_dedup.dedup_lines(frame(spark, [*rows, *no_id])).where("doc_id is null").collect()) == ["nine lines\nyours", "yours"]
    first = {r.doc_id: r.kept for r in line_dedup.dedup_lines(frame(spark, rows), keep_first=True).collect()}
    assert first[400].startswith("common line\n") and "common" not in first[401]


def test_line_dedup_edges(spark, corpus):
    got = line_dedup.dedup_lines(frame(spark, corpus)).collect()
    assert len(got) == len(corpus)
    assert [(r.n_lines, r.kept) for r in got if r.doc_id == 500] == [(1, "")]
    runs = next(r for r in got if r.doc_id == 401)
    assert runs.runs == [0, 2] and runs.n_dropped == 2
    twice = [*corpus, *[(700, "x\ncommon line\ny\nz")] * 3]
    got = [r for r in line_dedup.dedup_lines(frame(spark, twice).withColumn("kept", F.lit("clash")).withColumn("_text", F.lit(1))).collect() if r.doc_id == 700]
    assert [(r.kept, r.n_dropped, r.runs) for r in got] == [("x\ny\nz", 1, [1, 1])] * 3
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def naive_repeats(words):
    seen = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = set()
    for i in range(len(words) - 7):
        if seen[tuple(words[i : i + 8])] > 1:
            hit.update(range(i, i + 8))
    return len(hit)


def test_quality_rules(spark, corpus):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [*corpus, (700, "a b c d e f g h " * 2 + "x"), (701, "|*#é\nl\nl\n \n \n"), (702, "$$$ ### " * 60)]
    got = collections.defaultdict(list)
    for r in quality_rules.judge(frame(spark, rows), labels).collect():
        got[r.doc_id].append(r)
    for i, t in rows:
        words = (t or "").encode().split()
        lines = (t or "").split("\n")
        want = (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t or ""), sum(x in lines[:k] and bool(x.encode().strip()) for k, x in enumerate(lines)), naive_repeats(words))
        assert want in [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got[i]]
        for r in got[i]:
            assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
            assert r.kept == (not r.base_failed and r.llr >= quality_rules.THRESHOLD)
    clash = quality_rules.judge_texts(frame(spark, rows).withColumn("kept", F.lit("clash")).withColumn("n_words", F.lit("clash")), labels)
    assert clash.where("kept").count() == sum(r.kept for found in got.values() for r in found)
    assert not got[702][0].kept and quality_rules.judge(frame(spark, []), labels).count() == 0


def test_log_ratio_matches_plain_counts(spark):
    rows = [(1, "abcd"), (2, "abcdz"), (3, "zzzz")]
    sums = quality_rules.gram_counts(frame(spark, rows), {1})
    bucket = lambda g: int(next(quality_rules.gram_buckets(g))[0])
    assert sums[0, bucket(b"abcd")] == 2 and sums[1, bucket(b"abcd")] == 1 and sums[0, bucket(b"bcdz")] == 1 and sums[0].sum() == 4


def test_decontamination(spark, monkeypatch):
    rng = random.Random(2)
    words = lambda n: [f"t{rng.randrange(5000)}" for _ in range(n)]
    item = words(40)
    rows = [
        (1, " ".join(words(50) + item + words(30))), (2, " ".join(words(10) + item[20:] + words(7) + item[:20])), (3, " ".join(words(90))), (4, " ".join(item[:8] + words(20))),
        (5, None), (6, ""), (7, " ".join(item).upper().replace(" ", ", ")), (8, "tiny match here"), (None, " ".join(item)), (1, " ".join(item)), (9, "of " * 5000),
    ]
    items = spark.createDataFrame([(10, " ".join(item)), (11, "Tiny match"), (12, None), (13, "of of of of of of of")], "item_id long, text string")
    got = sorted((r.doc_id or -1, r.item_id, r.n_covered, r.n_tiles) for r in decontaminate.contaminated(frame(spark, rows), items).collect())
    assert got == [(-1, 10, 40, 1), (1, 10, 40, 1), (1, 10, 40, 1), (2, 10, 40, 2), (7, 10, 40, 1), (8, 11, 2, 1), (9, 13, 7, 1)]
    assert decontaminate.contaminated(frame(spark, rows), items.limit(0)).count() == 0
    for size in (500_000, 1):  # one block, and one for each item
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", size)
        left = decontaminate.clean(frame(spark, rows), items)
        assert sorted(r.doc_id for r in left.collect()) == [3, 4, 5, 6] and left.columns == frame(spark, []).columns
    assert decontaminate.contaminated(frame(spark, []), items).count() == 0
    assert decontaminate.clean(frame(spark, rows), items.limit(0)).count() == len(rows) and decontaminate.clean(frame(spark, []), items).count() == 0


def plain_tiling(d, i, size):
    """The longest free match, then the smallest places."""
    used_d, used_i, found = [False] * len(d), [False] * len(i), []
    while True:
        best = (0, 0, 0)
        for a in range(len(d)):
            for b in range(len(i)):
                n = 0
                while a + n < len(d) and b + n < len(i) and d[a + n] == i[b + n] and not used_d[a + n] and not used_i[b + n]:
                    n += 1
                best = max(best, (n, -a, -b))
        n, a, b = best[0], -best[1], -best[2]
        if n < size:
            return found
        found.append((a, b, n))
        used_d[a : a + n], used_i[b : b + n] = [True] * n, [True] * n


def test_tiling_matches_brute_force(monkeypatch):
    rng = random.Random(3)
    for kept in (64, 1, 2):
        monkeypatch.setattr(decontaminate, "KEPT", kept)
        for _ in range(40):
            d, i = [rng.randrange(3) for _ in range(40)], [rng.randrange(3) for _ in range(25)]
            assert sorted(decontaminate.tiles(np.array(d, np.int32), np.array(i, np.int32), 3)) == sorted(plain_tiling(d, i, 3))


def test_matches_are_those_of_the_whole_text():
    """Items and texts of few words: what lies under the seeds tiles like the whole text."""
    rng = random.Random(7)
    items = [[b"w%d" % rng.randrange(5) for _ in range(n)] for n in (30, 17, 5, 3)]
    index = decontaminate.Items([(k, b" ".join(x)) for k, x in enumerate(items)])
    for _ in range(30):
        text = [b"w%d" % rng.randrange(6) for _ in range(60)]
        want = set()
        for k, x in enumerate(items):
            found = plain_tiling(text, x, min(5, len(x)))
            if (n := sum(t[2] for t in found)) >= 0.5 * len(x):
                want.add((k, len(x), n, len(found)))
        assert set(index.matches(b" ".join(text))) == want


def test_a_long_repetitive_text_stays_small():
    """A million words against items of one repeated word and of a short cycle, in bounded memory."""
    import tracemalloc

    index = decontaminate.Items([(1, b"of " * 400), (2, b"a b c d e f g h i j " * 10)])
    tracemalloc.start()
    assert list(index.matches(b"of " * 1_000_000)) == [(0, 400, 400, 1)]
    assert list(index.matches(b"of of of of of of x " * 140_000)) == [(0, 400, 396, 66)]
    assert list(index.matches(b"a b c d e f g h i j " * 100_000)) == [(1, 100, 100, 1)]
    assert tracemalloc.get_traced_memory()[1] < 400e6
    tracemalloc.stop()


def test_bpe_round_trip_and_library(spark, corpus):
    pattern = public_tokenizers.PATTERN
    ranks = bpe.codec(TOKENIZER, pattern).ranks
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(6)
    odd = ["".join(rng.choice("aé'  \n\t1²ñ漢🙂\x1c_s") for _ in range(60)) for _ in range(30)] + ["x" * 900, "ab" * 400, "<|endoftext|>"]
    rows = [*corpus, *[(1000 + i, t) for i, t in enumerate(odd)]]
    docs = frame(spark, rows)
    want = collections.Counter((i, tuple(library.encode_ordinary(t or ""))) for i, t in rows)
    ids = bpe.encode(docs, TOKENIZER, pattern)
    assert collections.Counter((r.doc_id, tuple(r.ids)) for r in ids.collect()) == want
    back = bpe.decode(ids, TOKENIZER, pattern)
    assert collections.Counter((r.doc_id, bytes(r.data)) for r in back.collect()) == collections.Counter((i, (t or "").encode()) for i, t in rows)
    digest = lambda text: (lambda ids_: (len(ids_), hashlib.sha256(",".join(map(str, ids_)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))(library.encode_ordinary(text))
    got = collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, TOKENIZER, pattern).collect())
    assert got == collections.Counter((i, *digest(t or "")) for i, t in rows)
    assert bpe.digests(docs.limit(0), TOKENIZER, pattern).count() == 0


def test_bpe_pieces_and_long_words(monkeypatch):
    """Texts decoded in several pieces; words on either side of the bound, by query and by heap, as the library has them."""
    pattern = public_tokenizers.PATTERN
    codec = bpe.Codec(TOKENIZER, pattern)
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(12)
    monkeypatch.setattr(bpe, "PIECE", 7)
    lists = [np.array([rng.randrange(1000) for _ in range(n)], np.int32) for n in (0, 3, 50, 7, 14)]
    assert codec.decode(lists) == [b"".join(library.decode_single_token_bytes(int(t)) for t in x) for x in lists]
    words = ["".join(rng.choice("abcdeot") for _ in range(n)) for n in (511, 512, 513, 3000)] + ["é" * 256, "a" * 512]
    codec.learn(set(words))
    assert all(codec.ids[w] == ",".join(map(str, library.encode_ordinary(w))) for w in words)


def test_latin_splitter_agrees_on_every_code_point():
    """Texts that go to the standard module hold code points whose classes are those of the full module."""
    import re

    import regex

    plain = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and not re.search("[^\t\n\r\x20-\x7e\xa1-\u02af]", c)]
    assert plain == [c for c in plain if ord(c) < 0x2B0] and len(plain) > 600
    for name, own in (("L", bpe.LETTERS), ("N", bpe.NUMBERS)):
        assert [c for c in plain if re.fullmatch(f"[{own}]", c)] == [c for c in plain if regex.fullmatch(rf"\p{{{name}}}", c)]
    spaces = [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and re.fullmatch(f"[{bpe.SPACES}]", c)]
    assert spaces == [c for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and regex.fullmatch(r"\p{White_Space}", c)]
    find = bpe.splitter(public_tokenizers.PATTERN)
    library = regex.compile(public_tokenizers.PATTERN.replace(r"\s\p", bpe.SPACES + r"\p").replace(r"\s", f"[{bpe.SPACES}]").replace(r"\S", f"[^{bpe.SPACES}]")).findall
    rng = random.Random(13)
    for _ in range(300):
        text = "".join(rng.choice(plain + list("  \n\r'sS12 ") * 40) for _ in range(80))
        assert find(text) == library(text)


def test_url_filters(spark):
    urls = ["http://A.com/en/1", "https://x.example.com/en/77?q", "http://de.example.net/de/81", "http://b.net/de/", "ftp://c.org/es/#t", "noscheme", None, "http://plain.io", "http://h.io/a/b/c/d/e/f"]
    pages = spark.createDataFrame([(i, u, "h", True if i == 7 else None) for i, u in enumerate(urls)] + [(None, "http://a.com/fr/", "h", None)], "page_id long, url string, host string, bad boolean")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.judge(pages).collect()}
    assert got[0] == ("a.com", "/en/1", "com/en/", "block") and got[1] == ("x.example.com", "/en/77", "example.com/en/7", "allow")
    assert got[2][2:] == ("example.net/de/8", "block") and got[3][2:] == ("net/de/", "allow") and got[4][2:] == ("org/es/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][:2] == ("plain.io", "") and got[8][3] == "allow"
    assert url_filters.judge(pages.limit(0)).count() == 0


def tree_pages():
    """(page_id, url, bad): sections below 5 % of a host's pages and below the fourth level, alike branches, sparse bad hosts."""
    rows, n = [], iter(range(10**6))
    add = lambda url, bad, times: rows.extend((next(n), f"{url}/{k}", bad) for k in range(times))
    for k in range(60):  # 60 sections of one host, two of them bad
        add(f"http://s.io/part{k:02d}", k in (7, 31), 8)
        add(f"http://s.io/part{k:02d}", None, 4)
    add("http://deep.io/a/b/c/d/e/good", False, 30), add("http://deep.io/a/b/c/d/e/spam", True, 20), add("http://deep.io/a/b/c/d/e/spam", None, 5)
    for k in range(30):  # a bad host with one label in each branch
        add(f"http://sparse.io/x{k}", True, 1), add(f"http://sparse.io/x{k}", None, 1)
    add("http://ok.io/x", False, 20), add("http://ok.io/y", None, 3), add("http://none.io/y", None, 3)
    return rows


def test_url_tree_blocks_bad_branches_alone(spark):
    rows = tree_pages()
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame(rows, "page_id long, url string, bad boolean")).collect()}
    blocked = lambda url: ("/part07/" in url or "/part31/" in url) or "/spam/" in url or "sparse" in url
    assert {i for i, r in got.items() if r.verdict == "block"} == {i for i, url, _ in rows if blocked(url)}
    assert {r.template for i, r in got.items() if "/part07/" in rows[i][1] or "/part31/" in rows[i][1]} == {"s.io/[part07+]/*"}  # alike branches merge
    assert {got[i].template for i, url, _ in rows if "/spam/" in url} == {"deep.io/*/*/*/*/*/spam/*"}
    none = spark.createDataFrame([(i, url, None) for i, url, _ in rows], "page_id long, url string, bad boolean")
    assert url_filters.judge(none).where("verdict = 'block'").count() == 0


def test_url_tree_on_held_out_pages(spark):
    """Sections with 90 % or 10 % bad pages: verdicts of pages whose labels were not read."""
    rng = random.Random(11)
    rows = []
    for i in range(4000):
        host, section = rng.randrange(4), rng.randrange(12)
        rows.append((i, f"http://h{host}.io/s{section}/{'x' * rng.randrange(1, 4)}/{i}", rng.random() < (0.9 if (host + section) % 3 == 0 else 0.1)))
    seen = spark.createDataFrame([(i, u, b if i % 4 else None) for i, u, b in rows], "page_id long, url string, bad boolean")
    got = {r.page_id: r.verdict == "block" for r in url_filters.judge(seen).collect()}
    assert sum(got[i] == b for i, _, b in rows if i % 4 == 0) >= 0.87 * 1000


def test_url_labels_and_sql(spark):
    """Labels through the document number of the url; the SQL gives the same rows."""
    import duckdb

    rows = [(i, f"http://{('a.io', 'b.io', 'c.example.com')[i % 3]}/{('fr', 'de', 'en')[i % 7 % 3]}/t{i % 5}/{i}{('', '.html', '/', '?x=1')[i % 4]}") for i in range(600)]
    rows += [(700, None), (701, "no scheme 5"), (None, "http://a.io/fr/t1/7"), (702, "http://a.io/fr/t1/99999999999999999999"), (3, rows[3][1])]
    labels = [(i, int((i % 7 % 3 != 1) or i % 4 == 0), int(i % 31 == 0)) for i in range(0, 600, 2)] + [(None, 0, 0), (4, 0, 0), (8, None, 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("quality is not null").select("doc_id", F.expr("quality = 0 or toxic = 1").alias("bad"))
    found = url_filters.judge(url_filters.with_labels(pages, marks))
    db = duckdb.connect()
    db.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)"), db.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    db.execute("CREATE TABLE labels (doc_id BIGINT, quality INT, toxic INT)"), db.executemany("INSERT INTO labels VALUES (?, ?, ?)", labels)
    want = collections.Counter(db.execute(f"SELECT {', '.join(found.columns)} FROM ({url_filters.oracle()})").fetchall())
    assert collections.Counter(map(tuple, found.collect())) == want
    assert len({r[5] for r in want}) > 8 and {r[4] for r in want} == {"allow", "block"}


def test_chat_viterbi_matches_enumeration():
    import itertools

    model = chat.Model({("start", 0, 2): 5, ("step", 2, 4): 4, ("step", 4, 5): 3, ("step", 5, 2): 2, ("seen", 2, 7): 6, ("seen", 4, 9): 6, ("seen", 5, 1): 6})
    for seen in ([7, 9, 1], [7, 1, 1, 9], [9]):
        score = lambda p: model.start[0][p[0]] + model.seen[p[0], seen[0]] + sum(model.step[a, b] + model.seen[b, x] for a, b, x in zip(p, p[1:], seen[1:]))  # noqa: B023, E731
        best = max(score(p) for p in itertools.product(range(6), repeat=len(seen)))
        assert np.isclose(score(model.viterbi(seen)), best)


def conversations():
    rng = random.Random(15)
    rows = [(c, t, ("user", "assistant")[t % 2], "hi there?" if t % 2 == 0 else "A longer answer. " * 6 + "\nmore") for c in range(40) for t in range(4)]
    rows += [(c, t, ("user", "assistant")[t % 2], "\n".join(["word " * rng.randrange(1, 60)] * rng.randrange(1, 3)) + "\n" * (t % 5 == 0)) for c in (60, 61) for t in range(70)]  # longer than a piece
    rows += [(None, None, "user", "no id, no turn %d" % (k % 3)) for k in range(30)]  # many equal rows
    return rows + [(50, None, None, None), (None, 1, "user", ""), (51, 0, "tool", "x"), (51, 0, "tool", "x"), (52, 1, "user", "A: is this\nB: or that?")]


def test_chat_formatting(spark):
    """Every conversation's path has the score of the best path over all of it, and its parts join to one rendering."""
    rows = conversations()
    data = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, piece string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts, size in ((4, 64), (7, 5), (1, 3)):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            groups = chat.pieces(data, size)
            assert groups.agg(F.max(F.size("turns"))).first()[0] <= size
            model = chat.fit(groups)
            got = collections.defaultdict(list)
            for r in sorted(chat.format_conversations(groups, model).collect(), key=lambda r: r.piece):
                got[r.conv_id].append(r)
            found = {(r.conv_id, r.piece): r for r in groups.collect()}
            none_first = lambda x: (x is not None, x)
            for conv in {r[0] for r in rows}:
                turns = sorted(({"turn": t, "role": who, "text": x} for c, t, who, x in rows if c == conv), key=lambda d: tuple(none_first(d[k]) for k in ("turn", "role", "text")))
                assert [t.asDict() for r in got[conv] for t in found[conv, r.piece].turns] == turns
                text, states = chat.styled(turns, chat.style_of(conv))
                lines, seen = chat.features(text)
                best = model.viterbi(seen)
                score = lambda p: model.start[0][p[0]] + sum(model.step[a, b] for a, b in zip(p, p[1:])) + sum(model.seen[s, x] for s, x in zip(p, seen))  # noqa: B023, E731
                joined = "".join(r.rendered for r in got[conv])
                assert sum(r.n_lines for r in got[conv]) == len(lines) and sum(r.n_turns for r in got[conv]) == len(turns)
                if len(got[conv]) == 1:
                    assert joined == chat.rendered(model.turns(lines, best))
                elif joined != chat.rendered(model.turns(lines, best)):  # another path of the same score, or blank edges at a border
                    path, at = [], None
                    states_ = {r.piece: r for r in chat.borders(groups, model).collect()}
                    for r in got[conv]:
                        g = found[conv, r.piece]
                        part, _ = chat.styled([t.asDict() for t in g.turns], r.style)
                        path += model.viterbi(chat.features(part, chat._before(g.blank, g.first))[1], states_[r.piece].before, states_[r.piece].last)
                    assert np.isclose(score(path), score(best))
                assert joined.count("<|end|>") == sum(r.n_found for r in got[conv])
            assert sum(r.n_right for c in range(40) for r in got[c]) >= 0.98 * sum(r.n_lines for c in range(40) for r in got[c])
            assert len(got[None]) >= 31 / size
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    empty = chat.pieces(data.limit(0))
    assert chat.format_conversations(empty, chat.fit(empty)).count() == 0


def test_chat_parsing(spark):
    groups = chat.pieces(spark.createDataFrame(conversations(), "conv_id long, turn long, role string, text string"))
    model = chat.fit(groups)
    long = "User: hi\nAssistant: yes\n" * 20_000
    out = chat.parse_transcripts(spark.createDataFrame([(1, "User: hi\nAssistant: yes\nindeed"), (2, None), (3, long)], "id long, text string"), model).collect()
    assert [(r.role, r.text) for r in out if r.id == 1] == [("user", "hi"), ("assistant", "yes\nindeed")]
    assert len([r for r in out if r.id == 3 and r.text == "yes"]) == 20_000
    assert chat.Model.turns(model, ["A: is this"], [2]) == [("user", "A: is this")] and chat.Model.turns(model, ["A: is this"], [4]) == [("assistant", "is this")]


def test_toxicity_and_quality_held_out(spark):
    rng = random.Random(8)
    words = ["word%d" % i for i in range(300)]
    rows, labels = [], []
    for i in range(700):
        bad, junk = i % 4 == 0, i % 5 == 0
        text = [rng.choice(words) for _ in range(rng.randrange(20, 60))]
        if bad:
            text[rng.randrange(len(text))] = "awfulness"
        if junk:
            text = [w + "***" for w in text]
        rows.append((i, " ".join(text)))
        labels.append((i, int(not junk), int(bad)))
    docs, marks = frame(spark, [*rows, (None, "x"), (900, None), (901, "")]), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.train(toxicity.sample(docs, marks, "toxic", F.col("doc_id") % 3 != 1))
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(700) if i % 3 == 1]
    assert sum((got[i] >= 0.7) == (i % 4 == 0) for i in held) >= 0.97 * len(held) and 0 <= got[900] <= 1 and got[900] == got[901]
    net = quality_pu.fitted(docs, marks, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in quality_pu.score(docs, net).collect()}
    held = [i for i in range(700) if i % 4 == 2]
    assert sum((got[i] >= 0.7) == (i % 5 != 0) for i in held) >= 0.95 * len(held) and 0 <= got[901] <= 1
    none = marks.limit(0)
    assert toxicity.train(toxicity.sample(docs, none, "toxic", F.lit(True))).net is None and quality_pu.fitted(docs, none, F.lit(True)) is None
    assert toxicity.score(docs.limit(0), model).count() == 0 and quality_pu.score(docs.limit(0), net).count() == 0


def test_quality_risk_and_gradient():
    """The risk against a plain sum over texts, its gradient against differences, and the step against a negative bracket."""
    rng = np.random.default_rng(2)
    net = quality_pu.Net()
    net.params = [np.abs(x) for x in net.params]  # logits grow with every figure
    n = len(net.params[0])
    logit = lambda x: float(np.maximum(x @ net.params[0] + net.params[1], 0) @ net.params[2] + net.params[3][0])
    good, bad = lambda x: np.logaddexp(0, -logit(x)), lambda x: np.logaddexp(0, logit(x))
    for prior, scale, sign in ((0.3, 1, 1), (0.99, 3, -1)):
        p, u = rng.random((9, n)) * scale / 2000, rng.random((11, n)) / 2000
        want = prior * sum(map(good, p)) / 9, sum(map(bad, u)) / 11 - prior * sum(map(bad, p)) / 9
        assert np.allclose(net.risk(p, u, prior), want) and want[1] * sign > 0
        target = (lambda: sum(net.risk(p, u, prior))) if sign > 0 else (lambda: -net.risk(p, u, prior)[1])  # noqa: B023
        for k, g in enumerate(net.slopes(p, u, prior)):
            for at in [tuple(rng.integers(0, n) for n in g.shape) for _ in range(5)]:
                old = net.params[k][at]
                net.params[k][at] = old + 1e-5
                high = target()
                net.params[k][at] = old - 1e-5
                assert np.isclose((high - target()) / 2e-5, g[at], atol=1e-6)
                net.params[k][at] = old


def test_class_prior_of_known_mixtures():
    rng = np.random.default_rng(3)
    for share in (0.2, 0.5, 0.85):
        good, web = rng.normal(3, 1, 2000), np.concatenate([rng.normal(3, 1, int(4000 * share)), rng.normal(-3, 1, int(4000 * (1 - share)))])
        assert abs(quality_pu.class_prior(good, web) - share) < 0.04


def test_toxicity_forward_and_gradient():
    """Maxima and scores against loops over words and filters; one training step against differences of the loss."""
    texts_ = [b"bad words here and there again", b"", b"one", b"plain talk " * 30]
    net = toxicity.Net()

    def plain(text):
        words = toxicity.words_of(text)
        vectors = [net.table[r].sum(axis=0) for r in toxicity.table_rows(words)]
        vectors += [np.zeros(toxicity.DIM)] * (3 - len(vectors))
        out = []
        for w, f, b in zip(toxicity.WIDTHS, net.filters, net.bias):
            spots = [np.concatenate(vectors[i : i + w]) @ f + b for i in range(len(vectors) - w + 1)]
            out.append(np.maximum(np.max(spots, axis=0), 0))
        return np.concatenate(out)

    assert np.allclose(net.pooled(texts_), [plain(t) for t in texts_], atol=1e-4)
    labels = np.array([1, 0, 0, 1], np.float32)
    words = toxicity.Words()
    docs = [words(t) for t in texts_]
    loss = lambda: float(np.mean(np.logaddexp(0, net.logits(net.pooled(texts_))) - labels * net.logits(net.pooled(texts_))))
    before = loss()
    slope = []
    for k in range(4):  # the step goes against the slope of each output weight
        old = net.out[k]
        net.out[k] = old + 1e-2
        high = loss()
        net.out[k] = old - 1e-2
        slope.append((high - loss()) / 2e-2)
        net.out[k] = old
    start = net.out.copy()
    net.fit(docs, words.rows(), labels)
    assert loss() < 0.8 * before
    again = toxicity.Net()
    epochs, toxicity.EPOCHS = toxicity.EPOCHS, 1
    try:
        again.fit(docs, words.rows(), labels)
    finally:
        toxicity.EPOCHS = epochs
    moved = again.out - start
    assert all(m * s <= 0 for m, s in zip(moved[:4], slope) if abs(s) > 1e-4)


def test_long_texts_cross_the_chunk_borders(spark, monkeypatch):
    """Scores and figures of texts longer than a chunk or segment equal those of one piece."""
    rng = random.Random(14)
    text = " ".join(rng.choice(["aa", "bbb", "cccc", "é", "dd\n"]) for _ in range(3000)).encode()
    whole = quality_pu.vector(text), quality_rules.llr_score(text, np.arange(quality_rules.BUCKETS, dtype=np.float32)), toxicity.Net().pooled([text, b"x"])
    monkeypatch.setattr(quality_pu, "_CHUNK", 1000), monkeypatch.setattr(quality_rules, "_CHUNK", 1000), monkeypatch.setattr(toxicity, "SEGMENT", 200)
    parts = quality_pu.vector(text), quality_rules.llr_score(text, np.arange(quality_rules.BUCKETS, dtype=np.float32)), toxicity.Net().pooled([text, b"x"])
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(whole, parts))


def test_scores_of_ties_repeats_and_clashing_columns(spark):
    """Equal rows get equal scores whatever else they carry; labels that repeat count once."""
    rows = [(i, "good text about words %d" % (i % 50)) for i in range(60)] + [(100 + i, "awful *** junk") for i in range(20)] + [(5, "good text about words 5")] * 3
    docs = frame(spark, rows).withColumn("score", F.lit("clash")).withColumn("positive", F.lit(3)).withColumn("label", F.lit("clash"))
    marks = spark.createDataFrame([(i, 1, 0) for i in range(60)] * 2 + [(100 + i, 0, 1) for i in range(20)], "doc_id long, quality int, toxic int")
    net, model = quality_pu.fitted(docs, marks, F.lit(True)), toxicity.train(toxicity.sample(docs, marks, "toxic", F.lit(True)))
    for scored in (quality_pu.score(docs, net), toxicity.score(docs, model)):
        got = collections.defaultdict(set)
        for r in scored.collect():
            got[dict(rows)[r.doc_id]].add(r.score)
        assert all(len(x) == 1 for x in got.values()) and scored.count() == len(rows)


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C

    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(spark.read.parquet(f"{d}/documents.parquet"), labels).where("kept").collect()}
    docs = {i: t for i, t in docs.items() if i in kept}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    count = collections.Counter(k for t in docs.values() for k in {key(x) for x in t.split("\n")} if k)
    docs = {i: "\n".join(x for x in t.split("\n") if count[key(x)] < 10) for i, t in docs.items()}
    marks = {i: simhash.fingerprint(t.encode()) for i, t in docs.items()}
    group = {i: i for i in docs}
    for _ in range(8):
        for i in docs:
            group[i] = min(group[j] for j in docs if (marks[i] ^ marks[j]).bit_count() <= 2)
    docs = {i: t for i, t in docs.items() if group[i] == i}
    items = [(r.item_id, (r.text or "").encode()) for r in spark.read.parquet(f"{d}/benchmark.parquet").collect()]
    found = decontaminate.Items(items)
    docs = {i: t for i, t in docs.items() if not any(found.matches(t.encode()))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(TOKENIZER, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = {i: len(library.encode_ordinary(t)) for i, t in docs.items()}
    assert {r.doc_id: r.n_tokens for r in C.run(spark, d).collect()} == want


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empties, repeats, ties, a long text, clashing columns and empty tables, stage by stage against plain Python."""
    import corpus_pipeline as C

    rng = random.Random(21)
    words = [f"word{i}" for i in range(3000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, base = text(40), text(80)
    rows = [(i, text(60) + "\nsame line\n" + text(5)) for i in range(14)] + [(i, base) for i in (20, 21, None)] + [(22, base)] * 2
    rows += [(30, None), (31, ""), (32, "short text"), (33, text(30) + " " + item + " " + text(30)), (34, text(20_000)), (None, text(50)), (None, "lonely " + text(50)), (40, "of " * 200)]
    docs = spark.createDataFrame([(i, t, "en", None, None, "clash", "clash") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string, body string")
    labels, items = "doc_id long, quality int, toxic int", "item_id long, text string"
    for name, df in (("documents", docs), ("labels", spark.createDataFrame([], labels)), ("benchmark", spark.createDataFrame([(1, item), (None, None), (2, "")], items))):
        df.write.parquet(f"{tmp_path}/{name}.parquet")
    left = [(i, t) for i, t in rows if len((t or "").split()) >= 20 and t != "of " * 200]
    ids = collections.defaultdict(set)
    for i, t in left:
        for x in t.split("\n"):
            ids[x].add(i)
    left = [(i, "\n".join(x for x in t.split("\n") if len(ids[x] - {None}) < 10)) for i, t in left]
    assert not any("same line" in t for _, t in left)
    group = collections.defaultdict(list)
    for i, t in left:  # the texts are random: near duplicates are the copies alone
        group[simhash.fingerprint(t.encode())].append((i is None, i or 0, t))
    left = [(None if none else i, t) for none, i, t in map(min, group.values())]
    found = decontaminate.Items([(1, item.encode()), (None, b""), (2, b"")])
    left = [(i, t) for i, t in left if not any(found.matches(t.encode()))]
    assert {20, 34} <= {i for i, _ in left} and not {21, 22, 30, 31, 32, 33, 40} & {i for i, _ in left}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.codec(TOKENIZER, public_tokenizers.PATTERN).ranks, special_tokens={})
    want = collections.Counter((i, len(library.encode_ordinary(t))) for i, t in left)
    assert collections.Counter((r.doc_id, r.n_tokens) for r in C.run(spark, str(tmp_path)).collect()) == want
    empty = tmp_path / "none"
    for name, kind in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels), ("benchmark", items)):
        spark.createDataFrame([], kind).write.parquet(f"{empty}/{name}.parquet")
    assert C.run(spark, str(empty)).count() == 0
