r"""Chat formatting: conversations merged into prefix trees, shared turns emitted once.

A turn becomes ``<|im_start|>role\ntext<|im_end|>\n``.  Inside roles and texts a ``<`` that any
number of backslashes and a ``|`` follow gets one more backslash after it, so control
strings occur only where the template puts them, and taking the backslash away gives the text back.
In roles, backslashes and line ends are escaped before that.

Conversations with equal first turns share them.  A node of the tree is a prefix of turns, known by its length
and the XOR of digests of (place, role, text); running XORs and lengths come from a two-level prefix sum, so no task
orders a whole conversation.  Distinct conversations are ordered by the nodes taken where paths
part, which is the depth-first order; each node is emitted by the first conversation
through it.  Tokens are code points.  A tree's packed sequence is its nodes by ``start``; the token at offset o of
a node has the position id ``position + o`` and attends, besides its own node up to itself, to the
intervals ``ancestors`` of the sequence.  Nothing is gathered by tree, by first turn or by conversation, but for one short list
for each conversation: the intervals and nodes where its path parts from others.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sectiva.llm._common import materialise, small_batches
from sectiva.operators.ordered import ranged, running

START, END = "<|im_start|>", "<|im_end|>"
MASKED_ROLE = "assistant"
#: The conversation that the query adds to the table's: (role, text) of its turns.
PROBE = [(role, f"{END}{START}assistant ok") for role in ("user", "assistant")]
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
RESULT = "leaf string, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def escape_text(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def escape_role(c: Column) -> Column:
    return escape_text(F.regexp_replace(F.regexp_replace(c, r"\\", r"\\\\"), "\n", r"\\n"))


def unescape_text(s: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", s) if "<\\" in s else s


def unescape_role(s: str) -> str:
    s = unescape_text(s)
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], s) if "\\" in s else s


@dataclass
class Forest:
    """Prefix trees in depth-first order.

    ``nodes``: (tree, start, length, position, depth, node, parent, owner, text, loss_start, loss_length, subtree_end, ancestors), a row for each turn that is emitted.
    ``paths``: (owner, leaf, tree, intervals), a row for each distinct conversation: the intervals (of, start, stop) of its tree's sequence, in order, that hold it.
    ``members``: (conv, leaf), a row for each conversation.
    """

    nodes: DataFrame
    paths: DataFrame
    members: DataFrame


def placed(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contents, places) of (conv, turn, role, text) rows with neither null roles nor null texts.

    contents: (digest, text, loss_start, loss_length, length), a row for each distinct turn.  places: (conv, pos, node, parent,
    position, length, digest, n_turns), a row for each turn, without its text.
    """
    role, text = escape_role(F.col("role")), escape_text(F.col("text"))
    formatted = F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(f"{END}\n"))
    own = F.col("role") == MASKED_ROLE
    rows = turns.select(
        "conv", "turn", "role", F.sha2(formatted, 256).alias("digest"), formatted.alias("text"), F.when(own, len(START) + 1 + F.length(role)).otherwise(0).alias("loss_start"), F.when(own, F.length(text)).otherwise(0).alias("loss_length"), F.length(formatted).cast("bigint").alias("length"),
    )
    contents = rows.groupBy("digest").agg(*(F.first(c).alias(c) for c in ("text", "loss_start", "loss_length", "length")))
    light = rows.select("conv", "turn", "role", "digest", "length")
    dealt = ranged(light, "conv", "turn", "role", "digest")
    order = ["turn", "role", "digest"]
    numbered = running(dealt, order, {"pos": F.lit(1), "reach": F.col("length")}, ["conv"])
    mark = F.sha2(F.concat_ws(":", "pos", "digest"), 256)
    half = lambda at: F.conv(F.substring(mark, at, 15), 16, 10).cast("bigint")
    marked = numbered.withColumns({"h1": half(1), "h2": half(16)})
    keyed = running(marked, ["pos"], {"k1": F.col("h1"), "k2": F.col("h2")}, ["conv"], F.bit_xor, lambda a, b: a.bitwiseXOR(b))
    name = lambda pos, a, b: F.concat_ws(":", pos, a, b)
    total = dealt.groupBy("conv").agg(F.count("*").alias("n_turns")).withColumnRenamed("conv", "conv_")
    parent = F.when(F.col("pos") > 1, name(F.col("pos") - 1, F.col("k1").bitwiseXOR(F.col("h1")), F.col("k2").bitwiseXOR(F.col("h2"))))
    places = keyed.join(total, F.col("conv") == F.col("conv_")).select("conv", "pos", name(F.col("pos"), F.col("k1"), F.col("k2")).alias("node"), parent.alias("parent"), (F.col("reach") - F.col("length")).alias("position"), "length", "digest", "n_turns")
    return contents, materialise(places, "places")


def prefix_trees(turns: DataFrame, conv: str = "conv", turn: str = "turn", role: str = "role", text: str = "text") -> Forest:
    """The prefix trees of conversations, given as rows (conv, turn, role, text).

    ``conv`` must be a string without nulls.  Turns are taken by ``turn``, null first; turns of one conversation that
    share it by role, then by a digest of the text, repeated rows included.  Null roles and texts are empty.  Equal
    conversations share all their nodes and one row of ``paths``.  An empty table gives no rows.  Other columns are ignored.
    """
    small_batches(turns.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    contents, places = placed(turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), empty(role).alias("role"), empty(text).alias("text")))
    members = places.filter("pos = n_turns").select("conv", F.col("node").alias("leaf"))
    chosen = members.groupBy("leaf").agg(F.min("conv").alias("conv"))
    steps = materialise(places.join(chosen, "conv"), "steps")
    # Where paths part: the first turns, and nodes whose parent has other children, too.
    tree = steps.groupBy("node").agg(F.first("parent").alias("parent"))
    parting = tree.groupBy("parent").agg(F.count("*").alias("n")).filter("parent is null or n > 1").select(F.col("parent").alias("parting"))
    turned = steps.join(parting, F.col("parent").eqNullSafe(F.col("parting"))).groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("turned"))
    ends = steps.filter("pos = n_turns").select("leaf", "n_turns", (F.col("position") + F.col("length")).alias("whole"))
    ordered = ranged(turned.join(ends, "leaf"), "turned", "n_turns", "leaf")
    ranks = materialise(running(ordered, ["turned", "n_turns", "leaf"], {"owner": F.lit(1)}).select("leaf", "owner", "whole", "_range"), "ranks")
    # Each node belongs to the first conversation through it; what a conversation emits is the rest of its path.
    passed = steps.join(ranks.select("leaf", "owner"), "leaf")
    owned = passed.groupBy("node").agg(F.min("owner").alias("owner"), F.max("owner").alias("last"), *(F.first(c).alias(c) for c in ("parent", "pos", "position", "length", "digest")))
    owned = materialise(owned, "owned")
    begun = owned.groupBy("owner").agg(F.min("position").alias("begun"))
    emitted = ranks.join(begun, "owner", "left").withColumn("emitted", F.col("whole") - F.coalesce("begun", F.col("whole")))
    laid = running(emitted, ["owner"], {"stop": F.col("emitted")}).select("leaf", "owner", "begun", "whole", "stop", (F.col("stop") - F.col("emitted")).alias("first"))
    roots = owned.filter("pos = 1").select(F.col("node").alias("tree"), "owner", "last")
    bounds = laid.join(roots.select("tree", F.col("owner").alias("root_owner")), F.col("owner") == F.col("root_owner"), "left")
    root_of = steps.filter("pos = 1").select("leaf", F.col("node").alias("tree_of"))
    starts = bounds.filter("tree is not null").select(F.col("tree").alias("tree_of"), F.col("first").alias("zero"))
    laid = materialise(laid.join(root_of, "leaf").join(starts, "tree_of").select("leaf", "owner", F.col("tree_of").alias("tree"), (F.col("first") - F.col("zero")).alias("first"), (F.col("stop") - F.col("zero")).alias("stop"), "begun", "whole"), "laid")
    # Intervals of a path: one for each conversation that emitted a stretch of it.
    stretches = passed.select("leaf", "node", "position", "length").join(owned.select("node", F.col("owner").alias("of")), "node").groupBy("leaf", "of").agg(F.min("position").alias("position"), F.max(F.col("position") + F.col("length")).alias("reach"))
    whose = laid.select(F.col("owner").alias("of"), "first")
    intervals = stretches.join(whose, "of").select("leaf", F.struct("position", "of", F.col("first").alias("start"), (F.col("first") + F.col("reach") - F.col("position")).alias("stop")).alias("x"))
    paths = intervals.groupBy("leaf").agg(F.array_sort(F.collect_list("x")).alias("intervals"))
    paths = materialise(laid.join(paths, "leaf").select("owner", "leaf", "tree", "begun", "first", "intervals"), "paths")
    nodes = owned.join(contents.select("digest", "text", "loss_start", "loss_length"), "digest").join(paths.select("owner", "tree", "begun", "first", "intervals"), "owner")
    nodes = nodes.join(laid.select(F.col("owner").alias("last"), F.col("stop").alias("subtree_end")), "last")
    start = F.col("first") + F.col("position") - F.col("begun")
    above = F.filter("intervals", lambda x: x["of"] < F.col("owner"))
    run = F.when(start > F.col("first"), F.array(F.struct(F.col("first").alias("start"), start.alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
    ancestors = F.concat(F.transform(above, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"))), run)
    nodes = nodes.select("tree", start.alias("start"), "length", "position", F.col("pos").alias("depth"), "node", "parent", "owner", "text", "loss_start", "loss_length", "subtree_end", ancestors.alias("ancestors"))
    return Forest(materialise(nodes, "nodes"), paths.select("owner", "leaf", "tree", "intervals"), members)


def _read(batches):
    """Digests of each conversation from its formatted turns, which come in order; a conversation's turns are never held together."""
    leaf, state, done = None, None, []

    def closed():
        turns, loss, n, chars, loss_chars = state
        return (leaf, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars)

    def table(rows):
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = [x.split()[0] for x in RESULT.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    for batch in batches:
        for own, text, loss_start, loss_length in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if own != leaf:
                if state:
                    done.append(closed())
                leaf, state = own, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0]
            found, spoken = read_turns(text), unescape_text(text[loss_start : loss_start + loss_length])
            for role, said in found:
                state[0].update(f"{role}\n{said}\n".encode())
            state[1].update(spoken.encode())
            state[2:] = state[2] + len(found), state[3] + len(text), state[4] + len(spoken)
        if len(done) >= 1000:
            yield table(done)
            done = []
    if state:
        done.append(closed())
    yield table(done)


def read_turns(text: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a formatted text; raises if it is anything else than turns."""
    out, at = [], 0
    while at < len(text):
        m = TURN.match(text, at)
        if not m:
            raise ValueError("a formatted text doesn't follow the template")
        out.append((unescape_role(m[1]), unescape_text(m[2])))
        at = m.end()
    return out


def read_back(forest: Forest) -> DataFrame:
    """(conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, from the packed sequences alone.

    Intervals of a path pick the nodes; equal conversations are read once.
    """
    path = forest.paths.select("leaf", "tree", F.explode("intervals").alias("x")).select("leaf", F.col("tree").alias("tree_"), "x.of", F.col("x.start").alias("low"), "x.stop")
    here = (F.col("of") == F.col("owner")) & (F.col("start") >= F.col("low")) & (F.col("start") < F.col("stop")) & (F.col("tree") == F.col("tree_"))
    turns = path.join(forest.nodes.select("owner", "tree", "start", "depth", "text", "loss_start", "loss_length"), here).select("leaf", "text", "loss_start", "loss_length", "depth")
    read = turns.repartition("leaf").sortWithinPartitions("leaf", "depth").mapInArrow(_read, RESULT)
    return forest.members.join(read, "leaf").drop("leaf")


def keyed_conversations(conversations: DataFrame, extra: list[tuple[str, str]] = PROBE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, role, text) of a table, its ids as ``t:id`` (null: ``t:``), and of one more conversation, ``x:-1``."""
    own = conversations.select(F.concat(F.lit("t:"), F.coalesce(F.col(conv_id).cast("string"), F.lit(""))).alias("conv"), F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    probe = conversations.sparkSession.createDataFrame([("x:-1", i, r, t) for i, (r, t) in enumerate(extra)], "conv string, turn bigint, role string, text string")
    return own.unionByName(probe)


def format_conversations(conversations: DataFrame, **names: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation and of conversation -1, read back from the prefix trees.

    A null conv_id is one conversation; a table's own conversation -1 is a row beside the added one.
    """
    got = read_back(prefix_trees(keyed_conversations(conversations, **names)))
    conv_id = F.nullif(F.substring("conv", 3, 40), F.lit("")).cast("bigint")
    return got.select(conv_id.alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) AS r(i)),
e AS (SELECT *, length('<|im_start|>') + length(regexp_replace(replace(replace(role, '\', '\\'), chr(10), '\n'), '<(\\*)\|', '<\\\1|', 'g')) + 1
  + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + length('<|im_end|>') + 1 AS f FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(f) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
