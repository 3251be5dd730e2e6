"""References in templated SQL: found, resolved and replaced as column expressions, and a small renderer."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = r"\{\{([\s\S]*?)\}\}"
REF = r"""^ref\(\s*(?:'([^']*)'|"([^"]*)")\s*\)$"""
SOURCE = r"""^source\(\s*(?:'([^']*)'|"([^"]*)")\s*,\s*(?:'([^']*)'|"([^"]*)")\s*\)$"""


def has_template(text: Column) -> Column:
    return text.contains("{{") | text.contains("{%") | text.contains("{#")


def extract_refs(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, kind, source, name) of every reference in a block of its own; one-argument ref only."""
    blocks = df.select(key, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(BLOCK), F.lit(1))).alias("position", "block"))
    body = F.trim(F.regexp_replace("block", r"^\s+|\s+$", ""))
    pick = lambda pattern, i: F.concat(F.regexp_extract(body, pattern, i), F.regexp_extract(body, pattern, i + 1))
    ref, source = body.rlike(REF), body.rlike(SOURCE)
    found = blocks.withColumn("kind", F.when(ref, "ref").when(source, "source")).filter("kind is not null")
    name = F.when(F.col("kind") == "ref", pick(REF, 1)).otherwise(pick(SOURCE, 3))
    return found.select(key, "position", "kind", F.when(F.col("kind") == "source", pick(SOURCE, 1)).alias("source"), name.alias("name"))


def resolve_refs(refs: DataFrame, relations: DataFrame) -> DataFrame:
    """Refs with ``unique_id`` and ``target`` of relations (kind, source, name, unique_id, target), null if unknown."""
    keys = relations.select(F.col("kind").alias("k"), F.col("source").alias("s"), F.col("name").alias("n"), "unique_id", "target")
    on = (F.col("kind") == F.col("k")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("name") == F.col("n"))
    return refs.join(keys, on, "left").drop("k", "s", "n")


def replace_refs(text: Column, targets: dict[tuple, str]) -> Column:
    """The text with references replaced, whatever their quotes and spaces; keys are (name,) or (source, table)."""
    for key, target in targets.items():
        quoted = [rf"""(?:'{re.escape(k)}'|"{re.escape(k)}")""" for k in key]
        call = "source" if len(key) == 2 else "ref"
        text = F.regexp_replace(text, rf"\{{\{{\s*{call}\(\s*{(r'\s*,\s*').join(quoted)}\s*\)\s*\}}\}}", target.replace("$", r"\$"))
    return text


#: A reference with one name or a source with two, in quotes of either kind.
NAME = r"""(?:'[^']*'|"[^"]*")"""
CALL = rf"""\{{\{{\s*(?:ref\(\s*{NAME}|source\(\s*{NAME}\s*,\s*{NAME})\s*\)\s*\}}\}}"""


def replace_all_refs(models: DataFrame, relations: DataFrame) -> DataFrame:
    """``models`` (model, sql) with references to ``relations`` (kind, source, name, target) replaced; unknown ones stay.

    References are found in all texts at once and joined with the relations, so a project may have any number of both.
    Texts without references and null texts stay as they are; models that share a name have rows of their own.
    """
    rows = models.select(F.monotonically_increasing_id().alias("row"), "model", F.col("sql"))
    calls = rows.select("row", F.posexplode(F.regexp_extract_all("sql", F.lit(f"({CALL})"), F.lit(1))).alias("at", "call"))
    names = F.regexp_extract_all("call", F.lit(rf"({NAME})"), F.lit(1))
    plain = lambda x: F.expr(f"substring({x}, 2, length({x}) - 2)")
    keys = calls.withColumn("names", names).select("row", "at", "call", F.get("names", F.size("names") - 1).alias("n"), F.when(F.size("names") == 2, F.get("names", F.lit(0))).alias("s"))
    keys = keys.select("row", "at", "call", plain("n").alias("n"), plain("s").alias("s"))
    known = relations.groupBy("kind", "source", "name").agg(F.min("target").alias("target"))
    on = (F.col("n") == F.col("name")) & F.col("s").eqNullSafe(F.col("source")) & (F.col("kind") == F.when(F.col("s").isNull(), "ref").otherwise("source"))
    met = keys.join(known, on, "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("target", "call").alias("text")))).alias("found"))
    gaps = F.split("sql", CALL)
    both = F.transform(F.arrays_zip(gaps.alias("gap"), F.col("found").alias("own")), lambda x: F.concat(x["gap"], F.coalesce(x["own"]["text"], F.lit(""))))
    joined = rows.join(met, "row", "left")
    return joined.select("model", F.when(F.col("found").isNull(), F.col("sql")).otherwise(F.array_join(both, "")).alias("sql"))


class RenderError(ValueError):
    """A template that can't be rendered; ``code`` is the diagnostic's."""

    def __init__(self, message: str, code: str = "JINJA_RENDER_ERROR"):
        super().__init__(message)
        self.code = code


# What macros that only make sense in a warehouse are rendered as.
PLACEHOLDERS: dict[str, Any] = {
    "surrogate_key": "md5(concat_ws('|', *))",
    "generate_surrogate_key": "surrogate_key_value",
    "generate_series": "generate_series(0, 100)",
    "date_spine": "SELECT CURRENT_DATE as date_day",
    "union_relations": "SELECT * FROM source_table",
    "get_column_values": "column_value",
    "concat": "concat(column1, column2)",
    "star": "*",
    "pivot": "pivoted_columns",
    "unpivot": "unpivoted_columns",
    "groupby": "GROUP BY column1, column2",
    "get_url_host": "parse_url(url, 'HOST')",
    "get_url_parameter": "parse_url(url, 'QUERY')",
    "get_date_dimension": "SELECT date_day FROM date_dimension",
    "get_fiscal_periods": "SELECT date_day, fiscal_week_of_year, fiscal_period_number FROM fiscal_periods",
    "metric": "metric_calculation",
    "calculate": "(SELECT * FROM metric_table)",
    "split_part": "split_part(string, delimiter, part)",
    "get_columns_in_relation": [],
    "is_incremental": False,
    "statement": "",
    "values": [],
    "load_result": {"data": [], "table": {"columns": [{"name": "column1", "values": []}]}},
    "money": "::numeric(16,2)",
    "cents_to_dollars": "(amount / 100.0)",
    "get_payment_type_description": "payment_type_desc",
    "dynamic_partition": "partition_column",
}
#: Names of packages whose macros are called with a prefix.
NAMESPACES = ("dbt_utils", "dbt_date", "metrics", "dbt", "adapter")


@dataclass
class Context:
    variables: dict[str, Any] = field(default_factory=lambda: {"start_date": "2020-01-01"})
    target: dict[str, Any] = field(default_factory=lambda: {"name": "dev", "schema": "public", "type": "spark"})
    model_config: dict[str, Any] = field(default_factory=dict)
    env: dict[str, str] = field(default_factory=dict)
    resolve: Callable[..., str] | None = None


class _Undefined:
    def __init__(self, name: str):
        self.name = name


TOKEN = re.compile(r"""\s*(?:(\d+\.\d+|\d+)|'((?:[^'\\]|\\.)*)'|"((?:[^"\\]|\\.)*)"|([A-Za-z_]\w*)|(==|!=|<=|>=|\*\*|//|[-+*/%~<>=|.,:()\[\]{}]))""")


class _Expression:
    """A recursive descent over the operators that templates use."""

    def __init__(self, text: str, names: dict[str, Any], context: Context):
        self.items, self.at, self.names, self.context = [], 0, names, context
        pos, text = 0, text.strip()
        while pos < len(text):
            m = TOKEN.match(text, pos)
            if not m:
                raise RenderError(f"unexpected text in expression: {text[pos:pos + 20]}")
            number, single, double, name, mark = m.groups()
            value = single if single is not None else double
            self.items.append(("number", float(number) if "." in number else int(number)) if number else ("text", re.sub(r"\\(.)", r"\1", value)) if value is not None else ("name", name) if name else ("mark", mark))
            pos = m.end()
        self.items.append(("end", None))

    def peek(self, *marks: str) -> bool:
        kind, value = self.items[self.at]
        return kind in ("mark", "name") and value in marks

    def take(self, *marks: str) -> str | None:
        if self.peek(*marks):
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, mark: str) -> None:
        if not self.take(mark):
            raise RenderError(f"expected {mark}")

    def whole(self) -> Any:
        out = self.choice()
        if self.items[self.at][0] != "end":
            raise RenderError(f"unexpected {self.items[self.at][1]}")
        return out

    def choice(self) -> Any:
        value = self.either()
        if self.take("if"):
            test = self.either()
            other = self.choice() if self.take("else") else ""
            return value if truth(test) else other
        return value

    def either(self) -> Any:
        value = self.both()
        while self.take("or"):
            other = self.both()
            value = value if truth(value) else other
        return value

    def both(self) -> Any:
        value = self.negated()
        while self.take("and"):
            other = self.negated()
            value = other if truth(value) else value
        return value

    def negated(self) -> Any:
        return not truth(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        value = self.summed()
        while True:
            if self.take("is"):
                no, name = bool(self.take("not")), self.items[self.at][1]
                self.at += 1
                hit = {"none": value is None, "defined": not isinstance(value, _Undefined), "undefined": isinstance(value, _Undefined)}.get(name)
                if hit is None:
                    raise RenderError(f"unknown test {name}")
                value = hit != no
                continue
            no = self.peek("not") and self.items[self.at + 1] == ("name", "in")
            mark = "in" if no else self.take("==", "!=", "<=", ">=", "<", ">", "in")
            if no:
                self.at += 2
            if not mark:
                return value
            a, b = value, self.summed()
            value = {"==": lambda: a == b, "!=": lambda: a != b, "<": lambda: a < b, ">": lambda: a > b, "<=": lambda: a <= b, ">=": lambda: a >= b, "in": lambda: (a in b) != no}[mark]()

    def summed(self) -> Any:
        value = self.multiplied()
        while mark := self.take("+", "-", "~"):
            other = self.multiplied()
            value = shown(value) + shown(other) if mark == "~" else value + other if mark == "+" else value - other
        return value

    def multiplied(self) -> Any:
        value = self.filtered()
        while mark := self.take("*", "/", "//", "%"):
            other = self.filtered()
            value = {"*": lambda: value * other, "/": lambda: value / other, "//": lambda: value // other, "%": lambda: value % other}[mark]()  # noqa: B023
        return value

    def filtered(self) -> Any:
        value = -self.filtered() if self.take("-") else self.postfixed()
        while self.take("|"):
            name = self.items[self.at][1]
            self.at += 1
            args = self.arguments()[0] if self.take("(") else []
            value = apply_filter(name, value, args)
        return value

    def postfixed(self) -> Any:
        value = self.atom()
        while True:
            if self.take("."):
                name = self.items[self.at][1]
                self.at += 1
                value = member(value, name)
            elif self.take("["):
                key = self.choice()
                self.need("]")
                value = value[key]
            elif self.take("("):
                args, named = self.arguments()
                if not callable(value):
                    raise RenderError(f"{getattr(value, 'name', 'value')} can't be called")
                value = value(*args, **named)
            else:
                return value

    def arguments(self) -> tuple[list, dict]:
        args, named = [], {}
        while not self.take(")"):
            if self.items[self.at][0] == "name" and self.items[self.at + 1] == ("mark", "="):
                name = self.items[self.at][1]
                self.at += 2
                named[name] = self.choice()
            else:
                args.append(self.choice())
            if not self.take(","):
                self.need(")")
                break
        return args, named

    def atom(self) -> Any:
        kind, value = self.items[self.at]
        self.at += 1
        if kind in ("number", "text"):
            return value
        if kind == "name":
            fixed = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return fixed[value] if value in fixed else self.names.get(value, _Undefined(value))
        if value == "(":
            inner = self.choice()
            self.need(")")
            return inner
        if value in ("[", "{"):
            return self.collection("]" if value == "[" else "}")
        raise RenderError(f"unexpected {value}")

    def collection(self, end: str) -> Any:
        items: list = []
        while not self.take(end):
            key = self.choice()
            items.append((key, self.choice()) if end == "}" and not self.need(":") else key)
            if not self.take(","):
                self.need(end)
                break
        return dict(items) if end == "}" else items


def truth(x: Any) -> bool:
    return bool(x) and not isinstance(x, _Undefined)


def shown(x: Any) -> str:
    if isinstance(x, _Undefined):
        raise RenderError(f"Undefined variable: {x.name}", "JINJA_UNDEFINED_VARIABLE")
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


def member(value: Any, name: str) -> Any:
    if isinstance(value, dict):
        methods = {"items": lambda: list(value.items()), "keys": lambda: list(value), "values": lambda: list(value.values()), "get": value.get}
        return value[name] if name in value else methods.get(name, _Undefined(name))
    if isinstance(value, str) and name in ("upper", "lower", "strip", "replace", "split", "startswith", "endswith"):
        return getattr(value, name)
    if isinstance(value, list) and name == "append":
        return value.append
    return _Undefined(name)


def apply_filter(name: str, value: Any, args: list) -> Any:
    known: dict[str, Callable] = {
        "as_bool": lambda: str(value).lower() in ("true", "1", "yes"),
        "items": lambda: [list(x) for x in value.items()] if isinstance(value, dict) else value,
        "upper": lambda: shown(value).upper(),
        "lower": lambda: shown(value).lower(),
        "trim": lambda: shown(value).strip(),
        "join": lambda: (args[0] if args else "").join(map(shown, value)),
        "length": lambda: len(value),
        "default": lambda: args[0] if isinstance(value, _Undefined) else value,
        "replace": lambda: shown(value).replace(*args),
        "int": lambda: int(value),
        "string": lambda: shown(value),
        "first": lambda: value[0],
        "last": lambda: value[-1],
        "list": lambda: list(value),
    }
    if name not in known:
        raise RenderError(f"unknown filter {name}")
    return known[name]()


PIECE = re.compile(r"\{#.*?#\}|\{\{-?(.*?)-?\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)


def render(text: str, context: Context | None = None) -> str:
    """Expressions, comments, if, for and set; other statements are errors. Text without marks is returned as it is."""
    if not any(m in text for m in ("{{", "{%", "{#")):
        return text
    context = context or Context()

    def variable(name: str, *default: Any) -> Any:
        if name in context.variables:
            return context.variables[name]
        if default:
            return default[0]
        raise RenderError(f"Undefined variable: {name}", "JINJA_UNDEFINED_VARIABLE")

    resolve = context.resolve or (lambda *parts: ".".join(parts))
    names: dict[str, Any] = {k: (lambda *a, _v=v, **b: _v) for k, v in PLACEHOLDERS.items()}
    names |= {n: dict(names) for n in NAMESPACES}
    names |= {"ref": resolve, "source": resolve, "config": lambda *a, **b: "", "var": variable, "target": context.target, "model": {"config": context.model_config}, "range": lambda *a: list(range(*a))}
    names["env_var"] = lambda name, *default: context.env.get(name, *default) if name in context.env or default else variable(name)

    parts: list[tuple[str, str]] = []
    at = 0
    for m in PIECE.finditer(text):
        before = text[at : m.start()]
        at = m.end()
        if m.group().startswith(("{%-", "{{-")):
            before = before.rstrip()
        parts.append(("text", before))
        if m.group(1) is not None:
            parts.append(("value", m.group(1)))
        elif m.group(2) is not None:
            parts.append(("do", m.group(2)))
        if m.group().endswith(("-%}", "-}}")):
            at += len(text[at:]) - len(text[at:].lstrip())
    parts.append(("text", text[at:]))
    out, end = _block(parts, 0, names, context, True)
    if end != len(parts):
        raise RenderError(f"unexpected {parts[end][1]}")
    return out


def _block(parts: list, i: int, names: dict, context: Context, live: bool) -> tuple[str, int]:
    """Render until a statement that belongs to the caller; ``live``: whether expressions are evaluated."""
    out: list[str] = []
    value = lambda text: _Expression(text, names, context).whole()
    while i < len(parts):
        kind, text = parts[i]
        word = text.split(None, 1)[0] if kind == "do" and text else ""
        if kind == "text":
            out.append(text if live else "")
        elif kind == "value":
            out.append(shown(value(text)) if live else "")
        elif word in ("elif", "else", "endif", "endfor"):
            return "".join(out), i
        elif word == "set":
            m = re.match(r"set\s+(\w+)\s*=\s*(.*)", text, re.S)
            if not m:
                raise RenderError("set without a value")
            if live:
                names[m.group(1)] = value(m.group(2))
        elif word == "if":
            done, test = False, text[2:]
            while True:
                hit = live and not done and (test is None or truth(value(test)))
                part, i = _block(parts, i + 1, names, context, hit)
                done = done or hit
                out.append(part)
                if i == len(parts):
                    raise RenderError("if without end")
                word = parts[i][1].split(None, 1)[0]
                if word == "endif":
                    break
                test = None if word == "else" else parts[i][1][4:]
        elif word == "for":
            m = re.match(r"for\s+(\w+(?:\s*,\s*\w+)*)\s+in\s+(.*)", text, re.S)
            if not m:
                raise RenderError("for without in")
            targets, items = [x.strip() for x in m.group(1).split(",")], list(value(m.group(2))) if live else []
            body, end = i + 1, None
            for k, item in enumerate(items):
                names |= {targets[0]: item} if len(targets) == 1 else dict(zip(targets, item))
                names["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == len(items) - 1, "length": len(items)}
                part, end = _block(parts, body, names, context, True)
                out.append(part)
            if end is None:
                _, end = _block(parts, body, names, context, False)
            if end == len(parts):
                raise RenderError("for without end")
            i = end
        elif word == "do":
            if live:
                value(text[2:])
        else:
            raise RenderError(f"unsupported statement {word}")
        i += 1
    return "".join(out), i
