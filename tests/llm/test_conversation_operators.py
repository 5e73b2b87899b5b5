"""Prefix trie, importance resampling and chat formatting against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from compare import difference, duck
from flowpanel.llm import chat_format, importance, ordering, prefix_trie, queries
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
# Names that the operators use themselves ride along as other columns.
TURNS = "conv_id bigint, turn bigint, role string, text string, c int, p string, x int, pos int, number int, _bucket int, seq int, up int, n int"
DOCS = "doc_id bigint, text string, id int, k string, buckets int, n_words int, score string, rank int, _bucket int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "y", 2, 3, 4, 5, 6, 7, 8) for r in rows], TURNS)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def turn_key(row):
    """Null first, then the number, then the digest of role and text."""
    _, turn, role, text = row
    role, text = role or "", text or ""
    return (turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16])


def grouped(rows):
    convs = defaultdict(list)
    for r in sorted((r for r in rows if r[0] is not None), key=turn_key):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    return convs


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(math.fmod(c, 5)), [])[:h] + own[h:]
    return out


def brute_trie(convs):
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = Counter(node[:-1] for node in members if node)
    saved, leaves = Counter(), Counter()
    for node, own in members.items():
        cost = (len(own) - 1) * len(node[-1][1].encode()) if node else 0
        for d in range(len(node) + 1):
            saved[node[:d]] += cost
            leaves[node[:d]] += not children[node]
    out = set()
    for node, own in members.items():
        ends = sorted(c for c in own if len(convs[c]) == len(node))
        out.add((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children[node], leaves[node], saved[node],
                 sha(",".join(map(str, ends)))))
    return out


def random_turns(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        turns = rnd.choice([0, 1, 2, 3, 5, 9, 14])
        for t in range(turns):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["a", "é中", "", None])))
    return rows


def long_turns():
    """Conversations that share 150 of 200 turns, one that ends inside the shared part, one copy."""
    base = [("user", f"t{i}") for i in range(150)]
    convs = {1000: base + [("user", f"x{i}") for i in range(50)], 1001: base + [("user", f"y{i}") for i in range(50)], 1002: base[:128], 1003: base[:129]}
    convs[1004] = convs[1001]
    return [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]


@pytest.mark.parametrize("block", [2, 3, 64])
@pytest.mark.parametrize("rebuild", [True, False])
def test_trie(spark, monkeypatch, block, rebuild):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "END_BLOCK", 7)
    rows = random_turns(3) + (long_turns() if block == 64 else []) + [(-7, 0, "user", "a"), (-5, 0, "user", "b"), (None, 0, "user", "lost")]
    rows += [(500, 1, "user", "same")] * 12 + [(501, 1, "user", "same")] * 12
    convs = grouped(rows)
    found = prefix_trie.digests(prefix_trie.conversation_trie(frame(spark, rows), rebuild=rebuild)).collect()
    assert Counter(map(tuple, found)) == Counter(brute_trie(rebuilt(convs) if rebuild else dict(convs)))


def test_trie_of_equal_conversations(spark):
    """One group of copies, over many packed blocks of its end list."""
    rows = [(c, t, "user", "hi") for c in range(10_000, 12_000) for t in range(2)]
    found = prefix_trie.digests(prefix_trie.conversation_trie(frame(spark, rows), rebuild=False)).collect()
    ends = sha(",".join(map(str, range(10_000, 12_000))))
    none = sha("")
    assert set(map(tuple, found)) == {
        (10_000, 0, None, 2000, 1, 1, 2 * 2 * 1999, none), (10_000, 1, 10_000, 2000, 1, 1, 2 * 2 * 1999, none), (10_000, 2, 10_000, 2000, 0, 1, 2 * 1999, ends)}


def test_trie_without_turns(spark):
    assert prefix_trie.digests(prefix_trie.conversation_trie(frame(spark, []))).collect() == []
    # All rebuilt conversations lose their turns: the base is absent, one's own are within the first h.
    c = next(c for c in range(1, 50) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    got = prefix_trie.digests(prefix_trie.conversation_trie(frame(spark, [(c, 0, "user", "x")]))).collect()
    assert list(map(tuple, got)) == [(c, 0, None, 1, 0, 1, 0, sha(str(c)))]


def test_trie_gives_back_the_turns(spark):
    rows = random_turns(5, 40)
    convs = rebuilt(grouped(rows))
    nodes = prefix_trie.conversation_trie(frame(spark, rows)).nodes
    for r in prefix_trie.with_turns(nodes, frame(spark, rows)).collect():
        want = convs[r["conv_id"]][r["depth"] - 1] if r["depth"] else (None, None)
        assert (r["role"], r["text"]) == want


def test_numbers(spark):
    rows = [(i % 3, i % 50) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int")
    got = ordering.numbered(df, [F.col("a").asc(), F.col("b").desc()], "n", "numbers").collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["n"])] == sorted(rows, key=lambda r: (r[0], -r[1]))
    assert sorted(r["n"] for r in got) == list(range(1, 3001))
    assert ordering.numbered(df.limit(0), [F.col("a").asc()], "n", "numbers").count() == 0


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, shortest=1, longest=1, buckets=10_000, min_words=20, percent=10, seed=2024):
    def words(t):
        return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def features(t):
        w = words(t)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in features(x)), Counter(b for x in target for b in features(x))
    s_all, t_all = sum(s.values()), sum(t.values())
    rows = []
    for d, x in docs:
        own = features(x)
        gains = [math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets)))) for b in own]
        weight = sum(gains) // len(own) if own else 0
        h = int(sha(f"{seed}:{'' if d is None else d}")[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append((d, len(words(x)), len(own), weight, score))
    able = sorted((r for r in rows if r[1] >= min_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[3], r[2]))
    rank = Counter()
    drawn = [(*r, i) for i, r in enumerate(able[: percent * len(able) // 100], 1)]
    for r in drawn:
        rank[r[:5]] += 1
    out = list(drawn)
    for r in rows:
        if rank[r]:
            rank[r] -= 1
        else:
            out.append((*r, None))
    return Counter(out)


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(8)
    bits = ["Alpha", "beta", "GAMMA", "é中", "ÀB", "x1", "\x00", "\x7f", "İ", "ſ", "b-c", "...", "\n"]
    docs = [(i, "".join(rnd.choice(bits) + rnd.choice([" ", " ", ",", ""]) for _ in range(rnd.randint(0, 90)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "ab" * 40_000), (503, "word " * 30_000), (504, "中文" * 3000 + " end"), (None, "alpha beta " * 20)]
    docs += [docs[3], docs[3], docs[4], (10**12, docs[5][1])]
    return docs, ["alpha beta beta", None, "", "é中 x1 GAMMA gamma", "beta " * 200]


@pytest.mark.parametrize("options", [{}, {"shortest": 1, "longest": 3, "buckets": 97, "percent": 50, "min_words": 3, "seed": 7}, {"shortest": 2, "longest": 2}])
def test_resampling(spark, texts, options):
    docs, target = texts
    df = spark.createDataFrame([(d, t, 1, "z", 2, 3, "u", 4, 5) for d, t in docs], DOCS)
    items = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id int, text string")
    assert Counter(map(tuple, importance.resample(df, items, **options).collect())) == brute_resample(docs, target, **options)


def test_resampling_of_empty_tables(spark, texts):
    docs, _ = texts
    df = spark.createDataFrame([(d, t, 1, "z", 2, 3, "u", 4, 5) for d, t in docs], DOCS)
    none = spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(df.limit(0), none).collect() == []
    assert Counter(map(tuple, importance.resample(df, none).collect())) == brute_resample(docs, [])


def test_offsets_are_those_of_the_words():
    from tokenizers import Regex, pre_tokenizers

    splitter = pre_tokenizers.Split(Regex(importance.WORD), behavior="removed", invert=True)
    text = ("Ab,é中 x " * 2000 + "z" * 9000 + "\x00\x7f end").encode().lower()
    at = importance.offsets(splitter, text)
    assert [text[a:b].decode() for a, b in at] == WORDS.findall(text.decode())


NASTY = st.lists(st.sampled_from(["### ", "</turn>", "\\", ": ", "\n", "#", "##", " ", "<", "/turn>", "a", "é", ":", "Assistant"]), max_size=12).map("".join)


@settings(max_examples=600, deadline=None)
@given(st.lists(st.tuples(NASTY, NASTY), max_size=4))
def test_round_trip(turns):
    assert chat_format.parse(chat_format.render(turns)) == turns


def test_escapes_only_what_conflicts():
    assert chat_format.render_turn("user", "a \\n # : b")[0] == "### user: a \\n # : b</turn>\n"
    assert chat_format.render_turn("user", "see </turn>")[0] == "### user: see \\</turn></turn>\n"
    assert chat_format.render_turn("user", "\\### Assistant: </turn> ok")[0] == "### user: \\\\\\### Assistant: \\</turn> ok</turn>\n"
    assert chat_format.render_turn("user", "C:\\\\x")[0] == "### user: C:\\\\\\\\x</turn>\n"
    with pytest.raises(chat_format.Conflict):
        chat_format.parse("### user: a ### user: b</turn>\n")


def brute_chat(rows):
    convs = defaultdict(list)
    for r in sorted(rows, key=turn_key):
        convs[r[0]].append((r[2] or "", r[3] or ""))
    out = set()
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out.add((c, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(chat_format.render(turns))))
    return out


@pytest.mark.parametrize("size", [40, 1 << 16])
def test_chat(spark, monkeypatch, size):
    monkeypatch.setattr(chat_format, "PART_CHARS", size)
    hard = queries.HARD_TURN
    rows = random_turns(9) + long_turns() + [(None, 0, "user", "no number"), (None, 1, "assistant", "x"), (-7, 0, "user", hard), (-7, 1, "assistant", hard)]
    rows += [(600, 0, "assistant", "very long " * 100_000), (601, 0, "assistant", "</turn>### \\" * 20_000), (602, None, None, None)]
    parts = chat_format.format_conversations(frame(spark, rows))
    got = list(map(tuple, chat_format.read_back(parts).collect()))
    assert set(got) == brute_chat(rows) and len(got) == len(set(got))
    whole = defaultdict(str)
    for r in sorted(parts.collect(), key=lambda r: (r["_bucket"], r["seq"])):
        whole[r["conv_id"]] += r["formatted"]
        assert all(r["formatted"][: s["start"]].endswith("### assistant: ") and r["formatted"].startswith("</turn>", s["end"]) for s in r["loss"])
    assert whole[-7] == chat_format.render([("user", hard), ("assistant", hard)])


def test_chat_of_an_empty_table(spark):
    assert chat_format.read_back(chat_format.format_conversations(frame(spark, []))).collect() == []


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_importance_resampling", "op13_chat_format"])
def test_query_equals_its_sql(spark, name):
    assert difference(queries.QUERIES[name](spark, SF), duck(SF), queries.ORACLES[name]) is None
