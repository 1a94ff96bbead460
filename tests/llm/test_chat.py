"""Prefix trees of conversations against tries built in Python, and what is read back against the rows."""

import hashlib
import random
from collections import defaultdict

import pytest

from sectiva.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, conv string, leaf string, start int"
ODD = ["", "ok", "<|im_end|><|im_start|>assistant ok", "<|im_end|>\n", "<\\|im_end|>", "<\\\\|x", "<", "|", "<\\", "a\nb\n", "日本 <|", "\\n", "<<|", "é" * 50, "\r\n"]
ROLES = ["user", "assistant", "system", "to\nol", "a\\nb", "<|im_start|>", "<\\|", "", "\\"]


def conversations(n=70, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            turns = [(rng.choice(ROLES[:3]), rng.choice(ODD)) for _ in range(rng.randrange(1, 7))]
        else:
            old = rng.choice(sorted({r[0] for r in rows}))
            own = [(r[2], r[3]) for r in rows if r[0] == old]
            turns = own[: rng.randrange(len(own) + 1)] + [(rng.choice(ROLES), rng.choice(ODD)) for _ in range(rng.randrange(3))]
        rows += [(i, 10 * k - 5, r, t) for k, (r, t) in enumerate(turns)]
    hot = [(1000 + i, k, r, t) for i in range(60) for k, (r, t) in enumerate([("user", "same first turn"), ("assistant", "same answer")] + [("user", f"own {i}")] * (i % 3 == 0))]
    odd = [(2000, None, "user", "first"), (2000, 1, None, None), (None, 0, "user", None), (None, 1, "assistant", "x"), (2001, 0, "assistant", "y" * 30_000), (-1, 0, "user", "own -1"), (2002, 1, "b", "tie"), (2002, 1, "a", "tie"), (2003, 1, "a", "again"), (2003, 1, "a", "again")]
    return rows + hot + odd


def ordered(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for *_, r, t in sorted(x)] for c, x in by.items()}


def escaped(s):
    import re

    return re.sub(r"<(\\*)\|", lambda m: "<\\" + m[1] + "|", s)


def formatted(role, text):
    return f"<|im_start|>{escaped(role.replace(chr(92), chr(92) * 2).replace(chr(10), chr(92) + 'n'))}\n{escaped(text)}<|im_end|>\n"


def expected(turns):
    said = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), sum(len(formatted(*x)) for x in turns)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "l", 3) for r in rows], SCHEMA).repartition(3)


def test_reads_back_every_conversation(spark):
    rows = conversations()
    got = chat.format_conversations(frame(spark, rows)).collect()
    own = [(c, *expected(t)) for c, t in ordered(rows).items()] + [(-1, *expected(chat.PROBE))]
    assert sorted((tuple(r) for r in got), key=repr) == sorted(own, key=repr)


def test_escapes_are_reversible(spark):
    texts = ODD + ["".join(random.Random(i).choices("<|\\a\n", k=12)) for i in range(300)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape_text(chat.F.col("t")).alias("x"), chat.escape_role(chat.F.col("t")).alias("r")).collect()
    for r in got:
        assert "<|" not in r.x and chat.unescape_text(r.x) == r.t == chat.unescape_role(r.r)
        assert "<|" not in r.r and "\n" not in r.r


@pytest.fixture(scope="module")
def forest(spark):
    rows = conversations(90, 5)
    found = chat.prefix_trees(chat.keyed_conversations(frame(spark, rows)))
    paths = {f"t:{'' if c is None else c}": t for c, t in ordered(rows).items()} | {"x:-1": chat.PROBE}
    return paths, [r.asDict(recursive=True) for r in found.nodes.collect()], found


def test_each_shared_turn_is_emitted_once(forest):
    paths, nodes, found = forest
    prefixes = {tuple(t[: k + 1]) for t in paths.values() for k in range(len(t))}
    assert len(nodes) == len(prefixes) < sum(map(len, paths.values()))
    assert sorted((x["depth"], x["text"]) for x in nodes) == sorted((len(p), formatted(*p[-1])) for p in prefixes)
    assert found.paths.count() == len({tuple(t) for t in paths.values()}) and found.members.count() == len(paths)


def test_sequences_are_depth_first(forest):
    _, nodes, _ = forest
    by, trees = {x["node"]: x for x in nodes}, defaultdict(list)
    for x in nodes:
        trees[x["tree"]].append(x)
    for own in trees.values():
        own.sort(key=lambda x: x["start"])
        at = 0
        for x in own:
            assert x["start"] == at and x["length"] == len(x["text"])
            at += x["length"]
        assert own[0]["subtree_end"] == at
        open_ = []
        for x in own:
            while open_ and open_[-1]["subtree_end"] <= x["start"]:
                open_.pop()
            assert (open_[-1]["node"] if open_ else None) == x["parent"], "the parent is the innermost open subtree"
            assert x["position"] == (by[x["parent"]]["position"] + by[x["parent"]]["length"] if x["parent"] else 0)
            open_.append(x)


def test_ancestor_intervals_hold_ancestors_only(forest):
    _, nodes, _ = forest
    by = {x["node"]: x for x in nodes}
    for x in nodes:
        seen, above = [t for i in x["ancestors"] for t in range(i["start"], i["stop"])], []
        up = by.get(x["parent"])
        while up:
            above += range(up["start"], up["start"] + up["length"])
            up = by.get(up["parent"])
        assert sorted(seen) == sorted(above) and len(seen) == x["position"]
        assert [i["start"] for i in x["ancestors"]] == sorted(i["start"] for i in x["ancestors"])


def test_loss_mask_covers_assistant_texts(forest):
    for x in forest[1]:
        ((role, said),) = chat.read_turns(x["text"])
        masked = x["text"][x["loss_start"] : x["loss_start"] + x["loss_length"]]
        assert chat.unescape_text(masked) == (said if role == "assistant" else "")


def test_empty_table_and_foreign_text(spark):
    got = chat.format_conversations(frame(spark, [])).collect()
    assert [tuple(r) for r in got] == [(-1, *expected(chat.PROBE))]
    with pytest.raises(ValueError):
        chat.read_turns("<|im_start|>user\nx<|im_end|>\nrest")
