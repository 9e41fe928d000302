"""Prompt templates as one Column expression."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_TAG = re.compile(r"\{\{\s*(.+?)\s*\}\}|[ \t]*\{%-?\s*(.+?)\s*-?%\}\n?")
_FOR, _IF = re.compile(r"for (\w+) in ([\w.]+)$"), re.compile(r"if (not )?([\w.]+)$")

#: What the text of a value is where it counts as nothing.
NOTHING = ["", "false", "[]", "0"]

Part = Callable[[Mapping[str, Column]], Column]


def _value(name: str) -> Part:
    head, _, rest = name.partition(".")

    def get(values: Mapping[str, Column]) -> Column:
        if name in values:
            return values[name]
        if head not in values:
            raise KeyError(f"the template asks for {name}")
        return values[head][rest] if rest else values[head]

    return get


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(""))


def _parts(tokens: list, closes: tuple[str, ...]) -> tuple[Part, str]:
    """What stands up to one of ``closes``, and which one it was; takes its tokens off the list."""
    parts: list[Part] = []
    while tokens:
        plain, shown, tag = tokens.pop(0)
        if plain:
            parts.append(lambda _, s=plain: F.lit(s))
        elif shown:
            parts.append(lambda values, get=_value(shown): _text(get(values)))
        elif tag in closes:
            return (lambda values: F.concat(F.lit(""), *(p(values) for p in parts))), tag
        elif m := _FOR.match(tag):
            body, _ = _parts(tokens, ("endfor",))
            parts.append(lambda values, item=m[1], get=_value(m[2]), body=body: F.coalesce(F.array_join(F.transform(get(values), lambda x, i: body({**values, item: x, "loop.index": i + 1})), ""), F.lit("")))
        elif m := _IF.match(tag):
            body, end = _parts(tokens, ("else", "endif"))
            other = _parts(tokens, ("endif",))[0] if end == "else" else lambda _: F.lit("")
            one, two = (other, body) if m[1] else (body, other)
            parts.append(lambda values, get=_value(m[2]), one=one, two=two: F.when(_text(get(values)).isin(NOTHING), two(values)).otherwise(one(values)))
        else:
            raise ValueError(f"unknown tag: {tag}")
    if "" not in closes:
        raise ValueError(f"no {closes[-1]}")
    return (lambda values: F.concat(F.lit(""), *(p(values) for p in parts))), ""


def render(template: str, **values: Column) -> Column:
    """A template's text, with ``values`` in it.

    {{ name }} and {{ item.field }} show a value (null: nothing); {% for item in array %} .. {% endfor %} repeats, with
    {{ loop.index }} from 1; {% if name %} .. {% else %} .. {% endif %}, also with ``not``, asks whether a value is more than null,
    empty, false, 0, or an array without items. A tag takes the blanks before it on its line and the line break after it. The whole is
    one expression: a prompt costs no Python and no shuffle. A name without a value, or an open tag, is an error when it is built.
    """
    tokens, at = [], 0
    for m in _TAG.finditer(template):
        tokens += [(template[at : m.start()], None, None), (None, m[1], m[2])]
        at = m.end()
    tokens = [t for t in [*tokens, (template[at:], None, None)] if any(t)]
    return _parts(tokens, ("",))[0](values)


_TASKS = {
    "factual": "Answer from the evidence alone, with all that bears on the question.",
    "temporal": "Say what happened when: go by date, and give each event its date.",
    "numeric": "Give values with their units and dates, and compare them with their usual ranges.",
    "medication": "Name each drug with dose, start and reason, as far as the evidence tells.",
    "summary": "Sum up all sections of the record in order of weight.",
    "comparison": "Set the two side by side and say what has changed.",
}


def reasoning(kind: str) -> str:
    """The template for a query type; other types reason as for facts."""
    told = _TASKS.get({"temporal_numeric": "numeric"}.get(kind, kind), _TASKS["factual"])
    dated = "{% if chunk.date %} ({{ chunk.date }}){% endif %}" if kind in ("temporal", "temporal_numeric", "numeric", "comparison") else ""
    lines = f"[{{{{ loop.index }}}}] {{{{ chunk.source }}}}{dated}: {{{{ chunk.text }}}}"
    return (
        f"{told}\n\nQuestion: {{{{ query }}}}\n\n{{% if chunks %}}\nEvidence:\n{{% for chunk in chunks %}}\n{lines}\n{{% endfor %}}\n{{% else %}}\nThere is no evidence.\n{{% endif %}}\n"
        "Mark each fact with the [number] of its evidence. Write <reasoning>, <answer> and <source_chunks>."
    )


def reasoning_prompt(kind: Column, query: Column, chunks: Column) -> Column:
    """The prompt of a query by its type; ``chunks``: an array of (source, date, text)."""
    made = {k: render(reasoning(k), query=query, chunks=chunks) for k in ("temporal", "numeric", "temporal_numeric", "medication", "summary", "comparison", "factual")}
    out = made.pop("factual")
    for k, prompt in made.items():
        out = F.when(kind == k, prompt).otherwise(out)
    return out
