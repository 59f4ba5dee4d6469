"""Chat formatting by schema fingerprints, with SQL functions only.

Records of many datasets arrive as one struct column, as `spark.read.json` or `from_json` give it: each
record fills the fields of its own layout and leaves the others null. The nested paths of the fields that a
record fills (`prompt`, `pair.answer`, `messages[].role`) are listed and hashed; the hash selects one of the
declared mappings of LAYOUTS, which says where the turns are. Every mapping has the hash of its required paths with
each choice of its optional ones, so the selection is one lookup in a literal map. Paths that no mapping names
do not count, except below a text or role (a list of parts instead of a string), which no mapping can read.

Canonical turns are (role, text). The template writes each as

    <turn ROLE>
    TEXT</turn>

and a line feed, with the role in percent encoding. Inside texts, `<turn` and `</turn` get a backslash behind the `<`,
and such strings that already have backslashes there get one more, so that no text can end or begin a turn and
taking one backslash away restores it. The loss mask has one run for each turn: of `chars` code points of the output,
after `skip` come `take` under the loss, the (escaped) text of an assistant.

A record is a row: nothing is grouped, sorted or shuffled here. Null texts and roles count as empty, null elements of
a list as an empty turn; an empty list gives no turns and an empty output. A record with no mapping, or a null one, keeps
its fingerprint with null layout, turns, output and mask: none is dropped. Input columns named like a result column are
replaced, others kept; fields are only read inside the struct column. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

END = "</turn>\n"
ASSISTANT = "assistant"
RESULT = ["fingerprint", "layout", "turns", "formatted", "loss_mask"]
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """Where the turns of one layout are.

    Either a list with a role and a text in each element, or a role with the paths whose texts, joined
    by a blank line, are its turn. Roles are renamed by `roles`; `ignored` paths may be there too.
    """

    name: str
    items: str = ""
    role: str = ""
    text: str = ""
    roles: dict[str, str] = field(default_factory=dict)
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    required: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()

    @property
    def leaves(self) -> set[str]:
        """Paths of texts and roles."""
        if self.items:
            return {f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"}
        return {p for _, paths in self.turns for p in paths}

    @property
    def needed(self) -> set[str]:
        return {f"{self.items}[]"} if self.items else set(self.required)

    def fingerprints(self) -> Iterator[str]:
        free = sorted((self.leaves | set(self.ignored)) - self.needed)
        for some in chain.from_iterable(combinations(free, n) for n in range(len(free) + 1)):
            yield fingerprint_of(self.needed | set(some))


LAYOUTS = [
    Layout("messages", items="messages", role="role", text="content", ignored=("prompt", "system")),
    Layout("shared", items="conversations", role="from", text="value", roles={"human": "user", "gpt": ASSISTANT}, ignored=("system",)),
    Layout("dialogue", items="dialogue", role="speaker", text="text", roles={"bot": ASSISTANT}),
    Layout("prompt", turns=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("response",))), required=("prompt",)),
    Layout("completion", turns=(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("completion",))), required=("prompt", "completion")),
    Layout(
        "instruction", turns=(("system", ("system",)), ("user", ("instruction", "input")), (ASSISTANT, ("output",))), required=("instruction",)
    ),
    Layout("pair", turns=(("user", ("pair.question",)), (ASSISTANT, ("pair.answer",))), required=("pair.question",)),
]


def fingerprint_of(paths: set[str]) -> str:
    return hashlib.md5("\n".join(sorted(paths)).encode()).hexdigest()


Test = Callable[[Column], Column]


def _known(c: Column) -> Column:
    return c.isNotNull()


def _inside(name: str, test: Test) -> Test:
    return lambda c: test(c.getField(name))


def _any(test: Test) -> Test:
    return lambda c: F.coalesce(F.exists(c, lambda x: test(x)), F.lit(False))


def _filled(kind: T.DataType, path: str) -> Iterator[tuple[str, Test]]:
    """(path, test) of the fields of a type: the test tells whether a value fills the path."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            for sub, test in _filled(f.dataType, f"{path}.{f.name}" if path else f.name):
                yield sub, _inside(f.name, test)
    elif isinstance(kind, T.ArrayType):
        yield f"{path}[]", _known
        for sub, test in _filled(kind.elementType, f"{path}[]"):
            if sub != f"{path}[]":
                yield sub, _any(test)
    else:
        yield path, _known


def fingerprint(record: Column, kind: T.StructType, layouts: list[Layout] = LAYOUTS) -> Column:
    """Hash of the nested paths that a record fills, as far as a mapping could read them."""
    named = set().union(*[m.leaves | m.needed | set(m.ignored) for m in layouts])
    leaves = set().union(*[m.leaves for m in layouts])
    counts = lambda p: p in named or any(p.startswith((f"{leaf}.", f"{leaf}[")) for leaf in leaves)
    filled = sorted(((p, test) for p, test in _filled(kind, "") if counts(p)), key=lambda x: x[0])
    if not filled:
        return F.lit(fingerprint_of(set()))
    paths = F.array_compact(F.array(*[F.when(test(record), F.lit(p)) for p, test in filled]))
    return F.md5(F.array_join(paths, "\n").cast("binary"))


def _at(record: Column, kind: T.DataType, path: str) -> Column | None:
    """The value of a dotted path as text, or None where the schema has no such scalar."""
    for name in path.split("."):
        if not isinstance(kind, T.StructType) or name not in kind.names:
            return None
        record, kind = record.getField(name), kind[name].dataType
    return None if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else record.cast("string")


def _turn(role: Column, text: Column) -> Column:
    empty = F.lit("")
    return F.struct(F.coalesce(role, empty).alias("role"), F.coalesce(text, empty).alias("text"))


def mapped(record: Column, kind: T.StructType, layout: Layout) -> Column | None:
    """Canonical turns of a record of this layout; None if the schema cannot hold one."""
    none = F.lit(None).cast("string")
    if layout.items:
        listed = kind[layout.items].dataType if layout.items in kind.names else None
        if not isinstance(listed, T.ArrayType) or not isinstance(listed.elementType, T.StructType):
            return None
        part = lambda m, path: none if (found := _at(m, listed.elementType, path)) is None else found

        def turn(m: Column) -> Column:
            role = part(m, layout.role)
            for old, new in layout.roles.items():
                role = F.when(role == old, F.lit(new)).otherwise(role)
            return _turn(role, part(m, layout.text))

        return F.transform(record.getField(layout.items), turn).cast(TURNS)
    turns = []
    for role, paths in layout.turns:
        texts = [found for p in paths if (found := _at(record, kind, p)) is not None]
        if texts:
            filled = F.coalesce(*texts).isNotNull()
            turns.append(F.when(filled, _turn(F.lit(role), F.concat_ws("\n\n", *texts))))
    return F.array_compact(F.array(*turns)).cast(TURNS) if turns else None


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)(/?turn)", r"<\\$1$2")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)(/?turn)", "<$1$2")


def _header(role: Column) -> Column:
    return F.concat(F.lit("<turn "), F.url_encode(role), F.lit(">\n"))


def format_chats(df: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """`df` with RESULT: the fingerprint, the layout it selects, the turns, the output and its loss mask."""
    kind = df.schema[record].dataType
    if not isinstance(kind, T.StructType):
        raise ValueError(f"{record!r} is not a struct column")
    choice = {}
    for layout in layouts:
        for mark in layout.fingerprints():
            choice.setdefault(mark, layout.name)  # the first mapping that is declared for a set of paths
    known = F.create_map(*[F.lit(x) for pair in choice.items() for x in pair])
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in RESULT]
    held = F.col(f"`{record}`")
    rows = df.select(*kept, F.when(held.isNotNull(), fingerprint(held, kind, layouts)).alias("fingerprint"))
    rows = rows.withColumn("layout", known[F.col("fingerprint")])
    readable = [(m.name, turns) for m in layouts if (turns := mapped(held, kind, m)) is not None]
    turns = F.lit(None).cast(TURNS)
    for name, found in reversed(readable):
        turns = F.when(F.col("layout") == name, found).otherwise(turns)
    rows = rows.withColumn("turns", turns)
    piece = lambda t: F.concat(_header(t["role"]), escaped(t["text"]), F.lit(END))

    def run(t: Column) -> Column:
        head, body = F.char_length(_header(t["role"])), F.char_length(escaped(t["text"]))
        take = F.when(t["role"] == ASSISTANT, body).otherwise(F.lit(0))
        return F.struct((head + body + len(END)).alias("chars"), head.alias("skip"), take.alias("take"))

    return rows.withColumn("formatted", F.array_join(F.transform("turns", piece), "")).withColumn("loss_mask", F.transform("turns", run))


def _pieces(formatted: Column) -> Column:
    """The turns of an output, without their end marks."""
    parts = F.split(formatted, END, -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parsed(formatted: str | Column) -> Column:
    """Turns (role, text), read from an output."""
    formatted = F.col(formatted) if isinstance(formatted, str) else formatted

    def turn(piece: Column) -> Column:
        line = F.instr(piece, F.lit("\n"))
        role = F.url_decode(piece.substr(F.lit(len("<turn ") + 1), line - len("<turn ") - 2))
        return F.struct(role.alias("role"), unescaped(piece.substr(line + 1, F.char_length(piece))).alias("text"))

    return F.transform(_pieces(formatted), turn)


def loss_text(formatted: str | Column, mask: str | Column) -> Column:
    """All text under the loss mask, unescaped, read from an output and its mask."""
    formatted, mask = (F.col(c) if isinstance(c, str) else c for c in (formatted, mask))
    taken = F.zip_with(_pieces(formatted), mask, lambda p, m: unescaped(p.substr(m["skip"] + 1, m["take"])))
    return F.array_join(taken, "")


def records_of_turns(rows: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, record): conversations of (key, turn, role, text) rows, in the layouts that datasets use.

    Which layout a conversation gets follows from its key and from what the layout can hold without loss: a
    list with its own role names takes the three usual roles only, a prompt or an instruction one exchange. A
    conversation is one record, as a document is one text. Rows with equal turns are ordered by role and text.
    """
    text = F.coalesce("text", F.lit(""))
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("turn", "role", text.alias("text")))).alias("held"))
    role = lambda x: x["role"]
    roles = F.array_join(F.transform("held", lambda x: F.coalesce(role(x), F.lit("?"))), " ")
    usual = F.forall("held", lambda x: F.coalesce(role(x).isin("system", "user", ASSISTANT), F.lit(False)))
    one, led = roles == f"user {ASSISTANT}", roles == f"system user {ASSISTANT}"
    pick = F.pmod(F.coalesce(F.col(key), F.lit(0)), F.lit(5))
    layout = (
        F.when(usual & (pick == 1), "shared").when((one | led) & (pick == 2), "prompt")
        .when((one | led) & (pick == 3), "instruction").when(one & (pick == 4), "pair").otherwise("messages")
    )
    of = lambda name, value: F.when(F.col("_kind") == name, value)
    said = lambda i: F.element_at("held", i)["text"]
    renamed = lambda r: F.when(r == "user", "human").when(r == ASSISTANT, "gpt").otherwise(r)
    lists = {
        "messages": F.transform("held", lambda x: F.struct(role(x).alias("role"), x["text"].alias("content"))),
        "shared": F.transform("held", lambda x: F.struct(renamed(role(x)).alias("from"), x["text"].alias("value"))),
    }
    system = F.when(F.col("_kind").isin("prompt", "instruction") & (F.size("held") == 3), F.element_at("held", 1)["text"])
    record = F.struct(
        of("messages", lists["messages"]).alias("messages"), of("shared", lists["shared"]).alias("conversations"), system.alias("system"),
        of("prompt", said(-2)).alias("prompt"), of("prompt", said(-1)).alias("response"),
        of("instruction", said(-2)).alias("instruction"), F.lit(None).cast("string").alias("input"), of("instruction", said(-1)).alias("output"),
        of("pair", F.struct(said(-2).alias("question"), said(-1).alias("answer"))).alias("pair"),
    )
    return held.withColumn("_kind", layout).select(key, record.alias("record"))
