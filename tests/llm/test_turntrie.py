import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from tidewater.llm import turntrie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth int, seq long"


def brute(rows):
    own, members, kids = defaultdict(list), defaultdict(list), defaultdict(int)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own[conv].append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32], (role, text)))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        template = c - abs(c) % 100 * (1 if c >= 0 else -1)
        seq = own.get(template, [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append((c, len(seq) == d))
    for k in members:
        kids[k[:-1]] += bool(k)
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for a in range(len(k) + 1):
            leaves[k[:a]] += not kids[k]
            saved[k[:a]] += (len(m) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, m in members.items():
        ended = ",".join(str(c) for c in sorted(c for c, x in m if x))
        up = min(members[k[:-1]])[0] if k else None
        out.append((min(m)[0], len(k), up, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def tree(spark, rows, partitions="4"):
    df = spark.createDataFrame([(*r, 7, 8) for r in rows], SCHEMA).repartition(3)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    got = T.prefix_tree(T.sequences(T.grafted(T.turns(df)))).select(COLUMNS).collect()
    spark.conf.set("spark.sql.shuffle.partitions", before)
    return sorted(map(tuple, got), key=str)


def conversations(seed, ids, texts, depth):
    rng = random.Random(seed)
    return [(c, rng.choice([t, t, t, None]), rng.choice(["u", "a", None]), rng.choice(texts)) for c in ids for t in range(rng.choice(depth))]


@pytest.mark.parametrize(
    ("seed", "n", "texts", "depth", "partitions"),
    [
        (1, 400, ["x", "", None, "é😀"], [1, 2, 3, 9], "29"),  # nodes over many blocks
        (2, 500, ["x"], [1, 2, 4, 30], "17"),  # copies, prefixes of one another, deep nodes
        (3, 60, ["x", "y", "z" * 5000], [1, 3], "1"),
    ],
)
def test_trees(spark, seed, n, texts, depth, partitions):
    ids = random.Random(seed).sample(range(-300, 700), n)
    rows = conversations(seed, ids, texts, depth)
    rows += rows[:5] + [(None, 1, "u", "of no conversation")]
    assert tree(spark, rows, partitions) == brute(rows)


def test_few_conversations(spark):
    assert tree(spark, []) == []
    for rows in ([(5, 1, "u", "hi")], [(1, None, None, None)], [(600, i, "u", str(i)) for i in range(9)] + [(601, 0, "u", "0")]):
        assert tree(spark, rows) == brute(rows)
    # without a conversation 10000 to take turns from, these lose the only one they have
    turnless = [c for c in range(10_001, 10_100) if zlib.crc32(str(c).encode()) % 6 > 0][:3]
    rows = [(c, 0, "u", "lost") for c in turnless]
    got = tree(spark, rows)
    assert got == brute(rows) and len(got) == 1 and got[0][1:5] == (0, None, 3, 0)


def test_copies_that_fill_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(T, "PIECE", 7)
    rows = [(c, 0, "u", "the same" if c % 5 else f"own {c}") for c in range(1_000, 1_400)]
    rows = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 6 == 0 or r[0] % 100 == 0]
    more = [(c, 0, "u", "the same") for c in range(5_000, 6_000) if zlib.crc32(str(c).encode()) % 6 == 0]
    assert tree(spark, rows + more, "11") == brute(rows + more)


def test_query_and_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    cur = con.execute(T.OP13_SQL)
    assert [d[0] for d in cur.description] == COLUMNS
    want = sorted(cur.fetchall(), key=str)
    assert sorted(map(tuple, T.op13_prefix_tree(spark, sf).select(COLUMNS).collect()), key=str) == want
    assert want == brute(con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall())


def test_common_turns():
    a, b = "a" * T.DIGITS, "b" * T.DIGITS
    for x, y, n in ((a * 3, a * 3, 3), (a * 2, a * 3, 2), ("", a, 0), (a + b, a + a, 1), (b, a, 0), (a * 9 + b, a * 9, 9)):
        assert T.common_turns(x, y) == n
