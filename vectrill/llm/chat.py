r"""Chat formatting by schema fingerprints.

A record is a JSON document of any of several layouts. The sorted set of its nested field paths (array elements are
``[]``; value types don't matter) is hashed, and the hash selects a declarative mapping that says where the turns are.
Canonical turns are then rendered with a template that marks every turn and escapes control strings inside texts.

All of it is built-in functions on one row a record; grouping rows by turn into records is one partial aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: From about this size on, Spark can't hold a record as a VARIANT.
VARIANT_BYTES = 8 << 20
TURNS = "array<struct<role:string,text:string>>"
OPEN, MIDDLE, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of this template and of others a text may have been copied from. Group 1 is their first character,
#: group 2 the escapes so far; one more backslash is put after the first character and one is taken out to undo it.
_CONTROL = r"(\|im_start\|>|\|im_end\|>|\|newline\|>|\|system\|>|\|user\|>|\|assistant\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>)"
ESCAPE = r"([<\[])(\\*)" + _CONTROL
UNESCAPE = r"([<\[])\\(\\*)" + _CONTROL


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, r"$1$2$3")


#: Stands for a line break in a role, where a bare one ends the role.
NEWLINE = "<|newline|>"


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(NEWLINE))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(NEWLINE), F.lit("\n")))


@dataclass(frozen=True)
class Mapping:
    """Where a layout keeps its turns.

    ``steps`` are tried in order. ("turns", path, role field, text field) yields one turn for each element of an array;
    ("turn", role, path, ...) yields one turn of that role with the texts at the paths joined by an empty line, if one
    of them has any. ``required`` fields are in every record, ``optional`` ones may be missing. ``roles`` renames the layout's own
    names of roles; others stay as they are.
    """

    name: str
    required: tuple[str, ...]
    steps: tuple[tuple[str, ...], ...]
    optional: tuple[str, ...] = ()
    roles: dict = field(default_factory=dict)

    def path_sets(self):
        for bits in range(1 << len(self.optional)):
            yield {*self.required, *(p for i, p in enumerate(self.optional) if bits >> i & 1)}


ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "chatgpt": "assistant"}
MAPPINGS = (
    Mapping("messages", ("messages", "messages[].role", "messages[].content"), (("turns", "messages", "role", "content"),), ("id",)),
    Mapping("conversations", ("conversations", "conversations[].from", "conversations[].value"), (("turn", "system", "system"), ("turns", "conversations", "from", "value")), ("id", "system"), ALIASES),
    Mapping("turns", ("turns", "turns[].role", "turns[].text"), (("turns", "turns", "role", "text"),), ("id", "turns[].turn")),
    Mapping("instruction", ("instruction", "output"), (("turn", "system", "system"), ("turn", "user", "instruction", "input"), ("turn", "assistant", "output")), ("id", "input", "system")),
    Mapping("prompt_response", ("prompt", "response"), (("turn", "system", "system"), ("turn", "user", "prompt"), ("turn", "assistant", "response")), ("id", "system")),
    Mapping("prompt_completion", ("prompt", "completion"), (("turn", "user", "prompt"), ("turn", "assistant", "completion")), ("id",)),
    Mapping("question_answer", ("question", "answer"), (("turn", "user", "question", "context"), ("turn", "assistant", "answer")), ("id", "context")),
)


def paths_text(value: Column) -> Column:
    """The nested field paths of a VARIANT as one canonical text: its schema with the names of value types removed."""
    shape = F.call_function("schema_of_variant", value)
    shape = F.regexp_replace(shape, r": (?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DATE|TIMESTAMP|TIMESTAMP_NTZ|FLOAT|BINARY|DECIMAL\(\d+,\d+\))", ":")
    return F.regexp_replace(shape, r"ARRAY<(?:STRING|BIGINT|DOUBLE|BOOLEAN|VOID|VARIANT|DECIMAL\(\d+,\d+\))>", "ARRAY<>")


def _text_of(paths: set[str]) -> str:
    """What ``paths_text`` gives for a record with just these paths."""

    def tree(names: set[str]) -> str:
        heads = sorted({n.split(".")[0] for n in names if "[]" not in n.split(".")[0]})
        out = []
        for h in heads:
            under = {n[len(h) + 3 :] for n in names if n.startswith(f"{h}[].")}
            inner = {n[len(h) + 1 :] for n in names if n.startswith(f"{h}.")}
            out.append(f"{h}: ARRAY<{tree(under)}>" if under else f"{h}: {tree(inner)}" if inner else f"{h}:")
        return f"OBJECT<{', '.join(out)}>"

    return tree(paths)


def _string_at(value: Column, path: str) -> Column:
    return F.try_variant_get(value, f"$.{path}", "string")


def _steps(mapping: Mapping, value: Column) -> Column:
    parts = []
    for kind, *rest in mapping.steps:
        if kind == "turns":
            path, role, text = rest
            parsed = F.try_variant_get(value, f"$.{path}", f"array<struct<{role}:string,{text}:string>>")
            parts.append(_array_turns(parsed, role, text, mapping.roles))
        else:
            role, *paths = rest
            texts = F.filter(F.array(*[_string_at(value, p) for p in paths]), lambda x: x.isNotNull() & (x != ""))
            body = F.array_join(texts, "\n\n")
            given = F.coalesce(*[_string_at(value, p) for p in paths]).isNotNull() if role != "system" else body != ""
            parts.append(F.when(given, F.array(_turn(F.lit(role), body, {}))).otherwise(F.array().cast(TURNS)))
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def _array_turns(parsed: Column, role: str, text: str, roles: dict) -> Column:
    return F.transform(parsed, lambda x: _turn(x[role], x[text], roles))


def _turn(role: Column, text: Column, roles: dict) -> Column:
    name = role
    for alias, canonical in roles.items():
        name = F.when(role == alias, F.lit(canonical)).otherwise(name)
    return F.struct(F.coalesce(name, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Adds ``fingerprint`` (hash of the field paths), ``layout`` (the mapping's name) and ``turns``.

    ``record_col`` holds JSON text. A record that is null, malformed or of an unknown layout has null ``layout`` and
    ``turns`` and stays in the result; null texts and roles become empty. A record that is too large for a VARIANT has
    no fingerprint; it is read as the first layout that is one array of turns and fits.
    """
    value = F.try_parse_json(F.col(record_col))
    d = records.withColumns({"_value": value})
    d = d.withColumns({"_paths": paths_text(F.col("_value"))})
    d = d.withColumns({"fingerprint": F.xxhash64("_paths")})
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for m in mappings:
        marks = [F.xxhash64(F.lit(_text_of(p))) for p in m.path_sets()]
        chosen = F.col("_paths").isNotNull() & F.coalesce(F.col("fingerprint").isin(marks), F.lit(False))
        layout = F.when(chosen, F.lit(m.name)).otherwise(layout)
        turns = F.when(chosen, _steps(m, F.col("_value"))).otherwise(turns)
    large = F.col("_value").isNull() & (F.octet_length(record_col) >= VARIANT_BYTES)
    for m in reversed([m for m in mappings if len(m.steps) == 1 and m.steps[0][0] == "turns"]):
        _, path, role, text = m.steps[0]
        parsed = F.from_json(F.when(large, F.col(record_col)), f"{path} array<struct<{role}:string,{text}:string>>", {"maxStringLen": "2147483647"})[path]
        layout = F.when(large & parsed.isNotNull(), F.lit(m.name)).otherwise(layout)
        turns = F.when(large & parsed.isNotNull(), _array_turns(parsed, role, text, m.roles)).otherwise(turns)
    return d.withColumns({"layout": layout, "turns": turns}).drop("_value", "_paths")


def render(turns: Column) -> Column:
    """The formatted text: for each turn the opening mark, the role, a newline, the escaped text and the closing mark."""
    shown = F.transform(turns, lambda t: F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(CLOSE)))
    return F.array_join(shown, "")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted text: escaped texts hold no marks, so splitting at them is exact."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    body = F.transform(pieces, lambda p: F.substring(p, F.lit(1), F.length(p) - len(CLOSE)))
    return F.transform(
        body,
        lambda p: F.struct(unescape_role(F.substring_index(p, MIDDLE, 1)).alias("role"), unescape(F.substring(p, F.length(F.substring_index(p, MIDDLE, 1)) + 2, F.length(p))).alias("text")),
    )


def loss_lengths(turns: Column) -> Column:
    """The loss mask as run lengths over the formatted text, in code points: for each turn those without loss (marks,
    role; the whole turn of another role) and those with it (an assistant's escaped text), the closing mark last."""

    def runs(t):
        head = F.length(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(MIDDLE)))
        text = F.length(escape(t["text"]))
        ours = t["role"] == "assistant"
        return F.struct(F.when(ours, head).otherwise(head + text).alias("skip"), F.when(ours, text).otherwise(0).alias("learn"), F.lit(len(CLOSE)).alias("close"))

    return F.transform(turns, runs)


def learned_text(formatted: Column, loss_runs: Column) -> Column:
    """All text under the loss mask, unescaped, in order. Run lengths are taken turn by turn, so the cost is linear."""
    pieces = F.filter(F.split(formatted, r"<\|im_start\|>"), lambda p: p != "")
    texts = F.zip_with(pieces, loss_runs, lambda p, r: F.when(r["learn"] > 0, unescape(F.substring(p, r["skip"] - len(OPEN) + 1, r["learn"]))).otherwise(""))
    return F.array_join(texts, "")


def format_chats(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``fingerprint, layout, turns, formatted`` and ``loss_runs``.

    Unknown layouts have nulls there. A conversation without turns is an empty text. Extra columns are kept, repeated
    records give repeated rows and an empty table an empty table.
    """
    d = canonical_turns(records, record_col, mappings)
    return d.withColumns({"formatted": render(F.col("turns")), "loss_runs": loss_lengths(F.col("turns"))})


def records_of(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One ``messages`` record for each conversation of a table with a row a turn, in the order of turns (then role and
    text, so repeated turn numbers have one order). Null texts and roles count as empty."""
    one = F.struct(
        rows[turn_col].alias("turn"), F.coalesce(rows[role_col], F.lit("")).alias("role"), F.coalesce(rows[text_col], F.lit("")).alias("content")
    )
    d = rows.groupBy(rows[id_col].alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("all"))
    messages = F.transform("all", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return d.select("conv_id", F.to_json(F.struct(messages.alias("messages"))).alias("record"))
