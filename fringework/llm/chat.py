"""Chat formatting with DataFrame functions only.

A finite-state machine over roles checks the order of turns. A declarative template gives each role its opening and
closing marker and its loss flag; a conversation becomes text segments with flags and one formatted string. Control
strings inside texts are escaped reversibly, so the turns can be read back from the string.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"


@dataclass(frozen=True)
class Template:
    #: role -> opening marker, closing marker, whether its text bears loss
    turns: dict[str, tuple[str, str, bool]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n", False),
            "user": ("[INST] ", " [/INST]", False),
            "assistant": ("<s> ", " </s>", True),
        }
    )
    #: any other role: opening marker before the role's name, after it, closing marker
    other: tuple[str, str, str] = ("[ROLE] ", "\n", " [/ROLE]")
    #: what no text may hold; none has white space in it, and all markers are set off by white space
    control: tuple[str, ...] = ("<<SYS>>", "<</SYS>>", "[INST]", "[/INST]", "<s>", "</s>", "[ROLE]", "[/ROLE]")
    #: state machine: state -> role -> next state; what isn't listed is out of order
    order: dict[str, dict[str, str]] = field(
        default_factory=lambda: {
            "start": {"system": "briefed", "user": "asked"},
            "briefed": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    final: tuple[str, ...] = ("answered",)

    def __post_init__(self):
        if any(ESCAPE in s or not s for s in self.control):
            raise ValueError("a control string is empty or holds the escape character")

    def code(self, i: int) -> str:
        """What stands for control string number i in a text (0: the escape character itself); all are equally long."""
        return f"{ESCAPE}{i:0{len(f'{len(self.control):x}')}x}"


DEFAULT = Template()
REFUSED = ""  # the state after a turn out of order


def escape(c: Column, t: Template = DEFAULT) -> Column:
    """A backslash becomes ``\\0`` and control string number i ``\\i``, in hexadecimal digits of one width."""
    c = F.replace(c, F.lit(ESCAPE), F.lit(t.code(0)))
    for i, s in enumerate(t.control, 1):
        c = F.replace(c, F.lit(s), F.lit(t.code(i)))
    return c


def unescape(c: Column, t: Template = DEFAULT) -> Column:
    for i, s in enumerate(t.control, 1):
        c = F.replace(c, F.lit(t.code(i)), F.lit(s))
    return F.replace(c, F.lit(t.code(0)), F.lit(ESCAPE))


def _role_name(c: Column, t: Template) -> Column:
    return F.replace(escape(c, t), F.lit("\n"), F.lit(ESCAPE + "n"))


def _role_back(c: Column, t: Template) -> Column:
    return unescape(F.replace(c, F.lit(ESCAPE + "n"), F.lit("\n")), t)


def _by_role(role: Column, t: Template, known, other: Column) -> Column:
    out = None
    for name, spec in t.turns.items():
        out = (F if out is None else out).when(role == name, known(spec))
    return out.otherwise(other)


def format_chats(chats: DataFrame, template: Template = DEFAULT, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row for each conversation: ``id_col, segments array<struct<text, loss>>, formatted, n_turns, valid, first_bad_turn``.

    Turns come in the order of ``turn_col`` (nulls first), equal ones by role and text. A null role or text counts as
    empty; each row with a null id is a conversation of its own, as nothing says which belong together; repeated rows are
    turns of their own; extra columns are ignored; an empty table gives an empty result. A conversation is one row, however
    long: its turns have to fit a task. A conversation out of order is formatted like any other: ``valid`` is false and ``first_bad_turn`` the position (from
    0) of the first turn that the state machine refuses, or the number of turns if only the ending is wrong.
    """
    t = template
    empty = F.lit("")
    rows = chats.select(
        F.col(id_col).alias("id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("x"),
    )
    grouped = rows.filter("id IS NOT NULL").groupBy("id").agg(F.sort_array(F.collect_list("x")).alias("turns"))
    grouped = grouped.unionByName(rows.filter("id IS NULL").select("id", F.array("x").alias("turns")))

    def parts(x: Column) -> Column:
        role, text = x["role"], escape(x["text"], t)
        head, mid, tail = t.other
        opening = _by_role(role, t, lambda s: F.lit(s[0]), F.concat(F.lit(head), _role_name(role, t), F.lit(mid)))
        closing = _by_role(role, t, lambda s: F.lit(s[1]), F.lit(tail))
        loss = _by_role(role, t, lambda s: F.lit(s[2]), F.lit(False))
        seg = lambda c, flag: F.struct(c.alias("text"), flag.alias("loss"))
        return F.array(seg(opening, F.lit(False)), seg(text, loss), seg(closing, F.lit(False)))

    def step(acc: Column, x: Column) -> Column:
        state, nxt = acc["state"], F.lit(REFUSED)
        for now, moves in t.order.items():
            for role, then in moves.items():
                nxt = F.when((state == now) & (x["role"] == role), F.lit(then)).otherwise(nxt)
        bad = F.when(acc["bad"].isNull() & (nxt == REFUSED), acc["n"]).otherwise(acc["bad"])
        return F.struct(nxt.alias("state"), bad.alias("bad"), (acc["n"] + 1).alias("n"))

    start = F.struct(F.lit("start").alias("state"), F.lit(None).cast("int").alias("bad"), F.lit(0).alias("n"))
    out = grouped.select("id", F.flatten(F.transform("turns", parts)).alias("segments"), F.aggregate("turns", start, step).alias("fsm"))
    bad = F.coalesce(F.col("fsm.bad"), F.when(~F.col("fsm.state").isin(*t.final), F.col("fsm.n")))
    return out.select(
        F.col("id").alias(id_col),
        "segments",
        F.concat_ws("", F.transform("segments", lambda s: s["text"])).alias("formatted"),
        F.col("fsm.n").cast("long").alias("n_turns"),
        bad.isNull().alias("valid"),
        bad.alias("first_bad_turn"),
    )


def read_back(formatted: Column, template: Template = DEFAULT) -> Column:
    """The turns, array<struct<role, text>>, of a formatted string."""
    t = template
    quote = lambda s: r"\Q" + s + r"\E"
    forms = [f"{quote(o)}.*?{quote(c)}" for o, c, _ in t.turns.values()] + [f"{quote(t.other[0])}.*?{quote(t.other[2])}"]
    turns = F.regexp_extract_all(formatted, F.lit("(?s)" + "|".join(forms)), F.lit(0))

    def parse(x: Column) -> Column:
        head, mid, tail = t.other
        inner = F.substring(x, F.lit(len(head) + 1), F.length(x) - (len(head) + len(tail)))
        cut = F.instr(inner, mid)
        role, text = _role_back(F.substring(inner, F.lit(1), cut - 1), t), F.substring(inner, cut + len(mid), F.length(inner))
        for name, (o, c, _) in t.turns.items():
            here = F.startswith(x, F.lit(o))
            role = F.when(here, F.lit(name)).otherwise(role)
            text = F.when(here, F.substring(x, F.lit(len(o) + 1), F.length(x) - (len(o) + len(c)))).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return F.transform(turns, parse)


def loss_turns(turns: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask of turns that ``read_back`` returned."""
    lossy = [name for name, (_, _, loss) in template.turns.items() if loss]
    return F.concat_ws("", F.transform(F.filter(turns, lambda x: x["role"].isin(*lossy)), lambda x: x["text"]))


def loss_text(segments: Column, template: Template = DEFAULT) -> Column:
    """All text under the loss mask, unescaped."""
    return F.concat_ws("", F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"], template)))
