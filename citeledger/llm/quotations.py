"""Quotation linking: replies find the messages that they quote, and conversations are ordered by them.

A line that begins with ">" marks, each with blanks around it at will, is quoted at the level
that the number of marks gives; other lines are the author's own.  Runs of lines of one level
are passages, parted by blank lines too; a level as a whole is one more.  A passage quotes an
earlier message of the conversation where its words, lower-cased and without punctuation, occur
one after the other in that message's own text, be it whole paragraphs, some of their lines or
a part of a sentence; rewrapped lines stay equal.  A passage that no message holds as it stands
(shortened or altered) is looked up by its lines, sentences and the parts between omissions.

A passage of ``least`` words or more is linked to every such message.  A shorter one is linked
to the latest only, and a remnant of an altered passage that is that short to none.  The parent
of a message is taken at its lowest quoted level that is linked: before others the latest
message of which a passage is a run of whole lines, then one that holds a passage, then one
that holds a part of one, then one that holds a short passage.  ``links`` counts all messages
that it quotes at any level.  A message that quotes nothing it can be linked to follows the
message before it.

Each conversation is looked up by an index of its own words, built where it holds quotes.

``position`` numbers the messages of a conversation in reply order: after a message come its
replies with theirs, in the order of their turns.  ``text`` is the own text without quotes.

Defined cases: a null or empty text has no passages and an empty own text (null stays null).  A
null conv_id makes every such row a conversation of its own.  Null turns come first; rows that
share a turn are ordered by role and text, nulls first, and equal rows are each kept.  A quote
of what comes later, of another conversation or without words is no link.  A text of quotes
only is kept, with an empty text.  An empty table gives an empty result.  Other columns are not
read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeledger.llm.words import SQL_WORDS, WordHasher, clean_bytes, ngram_hashes
from citeledger.scratch import load

LEAST_WORDS = 3
_MARKS = re.compile(r"[ \t]*>(?:[ \t]*>)*[ \t]?")
#: Where a passage is parted that is not found as it stands: sentence ends and marks of omission.
_PARTS = re.compile(r"(?<=[.!?;:])\s+|\[[^\]]{0,20}\]|\.{2,}|\u2026")


def parse(text: str | None) -> tuple[list[tuple[int, str]], str]:
    """((level, passage) in order, own text without quotes); level 0 is the author's own."""
    passages: list[tuple[int, list[str]]] = []
    own: list[str] = []
    open_level = -1
    for line in (text or "").split("\n"):
        found = _MARKS.match(line)
        level = found.group().count(">") if found else 0
        body = line[found.end() :] if found else line
        if not level:
            own.append(line)
        if not body.strip():
            open_level = -1
        elif level == open_level:
            passages[-1][1].append(body)
        else:
            passages.append((level, [body]))
            open_level = level
    return [(level, "\n".join(lines)) for level, lines in passages], re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")


def _split(text: str | None) -> tuple[list[tuple[int, str]], str]:
    """((level, quoted passage) with each level of several as a whole too, own text)."""
    if not text or ">" not in text:
        return [], re.sub(r"\n{3,}", "\n\n", text or "").strip("\n")
    found, own = parse(text)
    quotes = [(level, p) for level, p in found if level]
    # blank lines inside a quote may be the quoter's
    for level in sorted({level for level, _ in quotes}):
        same = [p for at, p in quotes if at == level]
        if len(same) > 1:
            quotes.append((level, "\n".join(same)))
    return quotes, own


class _Words:
    """The words of a conversation's own texts, found by runs of up to ``GRAM``."""

    GRAM = 3

    def __init__(self, owns: list[str], hasher: WordHasher):
        lines = [own.split("\n") for own in owns]
        flat = [clean_bytes(line) for of in lines for line in of]
        s = hasher(list(range(len(flat))), flat)
        self.hashes = s.hashes
        self.first = s.first[np.concatenate([[0], np.cumsum([len(of) for of in lines])])]
        self.edge = np.zeros(len(s.hashes) + 1, bool)
        self.edge[s.first] = True
        self.grams: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def find(self, words: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """Messages before the given one that hold the words one after the other, and whether as whole lines."""
        n = len(words)
        size = min(self.GRAM, n)
        if size not in self.grams:
            grams = ngram_hashes(self.hashes, size)
            order = np.argsort(grams, kind="stable")
            self.grams[size] = grams, order, grams[order]
        grams, order, ranked = self.grams[size]
        own = ngram_hashes(words, size)
        low, high = np.searchsorted(ranked, own), np.searchsorted(ranked, own, side="right")
        rarest = int(np.argmin(high - low))
        at = order[low[rarest] : high[rarest]] - rarest
        at = at[at >= 0]
        owner = np.searchsorted(self.first, at, side="right") - 1
        fits = (owner < before) & (at + n <= self.first[np.minimum(owner + 1, len(self.first) - 1)])
        at, owner = at[fits], owner[fits]
        for j in [*range(0, n - size, size), n - size]:
            same = grams[at + j] == own[j]
            at, owner = at[same], owner[same]
            if not len(at):
                break
        return owner, self.edge[at] & self.edge[at + n]


def _met(messages: list[tuple[list[tuple[int, str]], str]], hasher: WordHasher, least: int) -> dict[int, tuple[int, int, int]]:
    """For messages (from 0) with quotes that earlier ones hold: (parent, level, links)."""
    index = _Words([own for _, own in messages], hasher)

    def hashed(parts: list[str]) -> list[np.ndarray]:
        s = hasher(list(range(len(parts))), [clean_bytes(p) for p in parts])
        return [s.of_row(i) for i in range(len(parts))]

    out = {}
    for m, (quotes, _) in enumerate(messages):
        links: set[int] = set()
        best = None
        for (level, passage), words in zip(quotes, hashed([p for _, p in quotes]) if quotes else [], strict=True):
            if not len(words):
                continue
            owner, whole = index.find(words, m)
            if len(owner) and len(words) < least:
                ranked = [(-level, 0, int(owner.max()))]
                links.add(ranked[0][2])
            elif len(owner):
                ranked = [(-level, 3 if w else 2, o) for o, w in zip(owner.tolist(), whole.tolist(), strict=True)]
                links.update(owner.tolist())
            else:
                parts = sorted({*passage.split("\n"), *(p for p in _PARTS.split(passage.replace("\n", " ")))})
                held = [index.find(w, m)[0] for w in hashed(parts) if len(w) >= least]
                ranked = [(-level, 1, o) for of in held for o in set(of.tolist())]
                links.update(o for _, _, o in ranked)
            best = max([*ranked, best] if best else ranked, default=None)
        if best:
            out[m] = best[2], -best[0], len(links)
    return out


def _placed(parent: list[int]) -> tuple[list[int], list[int]]:
    """Position and depth of a conversation's messages; parents count from 1, 0 is none."""
    replies: dict[int, list[int]] = {}
    for i, p in enumerate(parent):
        replies.setdefault(p, []).append(i + 1)
    position, depth = [0] * len(parent), [0] * len(parent)
    stack, at = [(c, 0) for c in reversed(replies.get(0, []))], 0
    while stack:
        m, d = stack.pop()
        at += 1
        position[m - 1], depth[m - 1] = at, d
        stack.extend((c, d + 1) for c in reversed(replies.get(m, [])))
    return position, depth


def _link(least: int):
    """From (conv_id, turn, role, text) rows in order, conversation after conversation: the result's rows.

    Every row with a null conv_id is a conversation.
    """

    def of(table: pa.Table, hasher: WordHasher) -> Iterator[pa.RecordBatch]:
        conv, n = table.column(0), table.num_rows
        if conv.null_count:
            start = np.arange(n)
        else:
            ids = conv.to_numpy()
            start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        texts = table.column(3).to_pylist()
        split = [_split(t) for t in texts]
        parents, levels, links, position, depth = [], [0] * n, [0] * n, [], []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), n], strict=True):
            parent = list(range(e - s))
            if any(quotes for quotes, _ in split[s:e]):
                for m, (to, level, count) in _met(split[s:e], hasher, least).items():
                    parent[m], levels[s + m], links[s + m] = to + 1, level, count
            places = _placed(parent)
            position += places[0]
            depth += places[1]
            parents += [s + p - 1 if p else None for p in parent]
        body = [None if t is None else own for t, (_, own) in zip(texts, split, strict=True)]
        turn = table.column(1).combine_chunks()
        out = pa.table(
            [
                conv, turn, table.column(2), pa.array(body, pa.string()), turn.take(pa.array(parents, pa.int64())),
                *(pa.array(v, pa.int64()) for v in (levels, links, position, depth)),
            ],
            names=["conv_id", "turn", "role", "text", "reply_to", "quoted_level", "links", "position", "depth"],
        )
        yield from out.combine_chunks().to_batches()

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column(0)
            if conv.null_count:
                yield from of(pa.Table.from_batches([batch]), hasher)
                continue
            ids = conv.to_numpy()
            # the last conversation may go on in the next batch
            cut = int(np.searchsorted(ids, ids[-1]))
            if held and (cut or held[-1].column(0)[-1] != conv[0]):
                yield from of(pa.Table.from_batches([*held, batch.slice(0, cut)]), hasher)
                held = []
            elif cut:
                yield from of(pa.Table.from_batches([batch.slice(0, cut)]), hasher)
            held.append(batch.slice(cut))
        if held:
            yield from of(pa.Table.from_batches(held), hasher)

    return link


def linked(messages: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(conv_id, turn, role, text, reply_to, quoted_level, links, position, depth) of each message.

    reply_to is the turn of the parent (null: none); quoted_level the level of the quote that
    led there (0: none did).
    """
    rows = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text"
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    schema = (
        "conv_id long, turn long, role string, text string, reply_to long, quoted_level long, links long, position long, depth long"
    )
    known = rows.where("conv_id is not null").repartition("conv_id").sortWithinPartitions("conv_id", *order)
    alone = rows.where("conv_id is null")
    return known.mapInArrow(_link(least), schema).unionByName(alone.mapInArrow(_link(least), schema))


def quoting(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, text) of which every third begins with a quote of all that was said two before it."""
    before = F.lag("text", 2).over(Window.partitionBy("conv_id").orderBy("turn"))
    quote = F.when((F.col("conv_id") + F.col("turn")) % 3 == 0, before)
    marked = F.concat(F.lit("> "), F.replace(quote, F.lit("\n"), F.lit("\n> ")), F.lit("\n"), "text")
    return messages.select("conv_id", "turn", "role", F.coalesce(marked, "text").alias("text"))


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, with quotes put in: the table has none of its own."""
    return linked(quoting(load(spark, sf_dir, "conversations")))


_WORDS = SQL_WORDS.replace("text", "x")
_LINES = f"[y FOR y IN [array_to_string({_WORDS}, ' ') FOR x IN string_split(orig, chr(10))] IF y <> '']"
SQL = f"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, text AS orig, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations
),
w AS (
  SELECT *, array_to_string({_LINES}, ' ') AS said, chr(1) || array_to_string({_LINES}, chr(1)) || chr(1) AS lines FROM m
),
q AS (SELECT a.conv_id, a.i, b.said, b.lines FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.i = a.i - 2 WHERE (a.conv_id + a.turn) % 3 = 0 AND b.said <> ''),
f AS (
  SELECT q.conv_id, q.i, o.i AS place, contains(o.lines, q.lines) AS whole, len(string_split(q.said, ' ')) AS n
  FROM q JOIN w o ON o.conv_id = q.conv_id AND o.i < q.i AND contains(' ' || o.said || ' ', ' ' || q.said || ' ')
),
l AS (
  SELECT conv_id, i, CASE WHEN max(n) < {LEAST_WORDS} THEN 1 ELSE count(*) END AS links,
         CASE WHEN max(n) < {LEAST_WORDS} THEN max(place) ELSE arg_max(place, CASE WHEN whole THEN 1000000 ELSE 0 END + place) END AS parent FROM f GROUP BY 1, 2
),
p AS (
  SELECT m.*, coalesce(l.links, 0) AS links, CASE WHEN l.parent IS NULL THEN 0 ELSE 1 END AS level, coalesce(l.parent, m.i - 1) AS parent
  FROM m LEFT JOIN l ON m.conv_id = l.conv_id AND m.i = l.i
),
t AS (
  SELECT conv_id, i, [i] AS path FROM p WHERE parent = 0
  UNION ALL SELECT p.conv_id, p.i, list_append(t.path, p.i) FROM t JOIN p ON p.conv_id = t.conv_id AND p.parent = t.i
)
SELECT p.conv_id, p.turn, p.role, trim(p.orig, chr(10)) AS text, o.turn AS reply_to, p.level::BIGINT AS quoted_level, p.links::BIGINT AS links,
       row_number() OVER (PARTITION BY p.conv_id ORDER BY t.path) AS position, (len(t.path) - 1)::BIGINT AS depth
FROM p JOIN t ON t.conv_id = p.conv_id AND t.i = p.i LEFT JOIN m o ON o.conv_id = p.conv_id AND o.i = p.parent
"""
