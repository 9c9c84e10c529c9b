"""Lifecycles of objects from facts, merged over methods and grouped into chunks."""

from __future__ import annotations

import ast
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from ...functions.fixed import ACTOR_LIKE, INLINE_PROPERTY
from .facts import Call, Facts

INLINE = "inline"


@dataclass
class Lifecycle:
    variable: str | None
    cls: str
    role: str
    statements: list[ast.stmt] = field(default_factory=list)
    properties: list[tuple[str, str]] = field(default_factory=list)  # (variable, class)
    mapper: str | None = None
    actor: str | None = None
    methods: list[str] = field(default_factory=list)
    calls: list[Call] = field(default_factory=list)


def distinct(items: Iterable) -> list:
    return list(dict.fromkeys(items))


def distinct_calls(calls: Iterable[Call]) -> list[Call]:
    """The first call of each method."""
    first: dict[str, Call] = {}
    for c in calls:
        first.setdefault(c[0], c)
    return list(first.values())


def _line(s: ast.stmt) -> int:
    return s.lineno


def build(facts: Facts, role: Callable[[str], str]) -> list[Lifecycle]:
    """Objects in the order of their first assignment, then classes whose functions are called without an object.

    A variable that is another's property has no lifecycle of its own; its statements go to its parent.
    """
    out, taken = [], set()
    for var, cls in facts.classes.items():
        if var in taken or var in facts.owners:
            continue
        owned = [p for p in facts.properties.get(var, ()) if p in facts.classes]
        statements = facts.statements.get(var, []) + [s for p in owned for s in facts.statements.get(p, [])]
        properties = [(p, facts.classes[p]) for p in owned]
        if var in facts.inline and cls in INLINE_PROPERTY:
            properties.append((INLINE, INLINE_PROPERTY[cls]))
        calls = facts.calls.get(var, [])
        out.append(Lifecycle(var, cls, role(cls), sorted(statements, key=_line), properties, facts.mapper_of.get(var), facts.actor_of.get(var), distinct(m for m, _ in calls), distinct_calls(calls)))
        taken |= {var, *owned}
    for cls, statements in facts.statics.items():
        ordered = sorted(statements, key=_line)
        calls = [(s.value.func.attr, list(map(ast.unparse, s.value.args))) for s in ordered]
        out.append(Lifecycle(None, cls, role(cls), ordered, methods=distinct(m for m, _ in calls), calls=distinct_calls(calls)))
    return out


def merge(lifecycles: Iterable[Lifecycle]) -> list[Lifecycle]:
    """One lifecycle for a variable of several methods, with or without `self.`; the first mapper and actor stay. Static ones are dropped."""
    by: dict[str, Lifecycle] = {}
    for lc in lifecycles:
        if lc.variable is None:
            continue
        key = lc.variable.replace("self.", "")
        if (have := by.get(key)) is None:
            by[key] = replace(lc)
        else:
            by[key] = replace(have, statements=have.statements + lc.statements, properties=have.properties + lc.properties, methods=have.methods + lc.methods, calls=have.calls + lc.calls, mapper=have.mapper or lc.mapper, actor=have.actor or lc.actor)
    return list(by.values())


def _is_actor(lc: Lifecycle) -> bool:
    return ("Actor" in lc.cls and not lc.cls.endswith("Property")) or lc.cls in ACTOR_LIKE


def group_properties(own: list[Lifecycle]) -> list[list[Lifecycle]]:
    """Groups of [mapper's properties, mapper, actor's properties, actor] by actor, then of mappers without actor, then the rest alone.

    Static lifecycles share the missing name, so only the first of them stays; a mapper of two actors is in both groups.
    """
    by = {lc.variable: lc for lc in own if lc.variable}
    done: set[str | None] = set()
    groups = []

    def add(group: list[Lifecycle], lc: Lifecycle, again: bool = False) -> None:
        if again or lc.variable not in done:
            group.append(lc)
            done.add(lc.variable)

    def parts(lc: Lifecycle) -> list[Lifecycle]:
        return [by[v] for v, _ in lc.properties if v != INLINE and v in by]

    def emit(wanted: Callable[[Lifecycle], bool], with_mapper: bool, with_parts: bool) -> None:
        for lc in own:
            if lc.variable in done or not wanted(lc):
                continue
            group: list[Lifecycle] = []
            if with_mapper and lc.mapper in by:
                for p in [*parts(by[lc.mapper]), by[lc.mapper]]:
                    add(group, p, again=True)
            for p in parts(lc) if with_parts else ():
                add(group, p)
            add(group, lc, again=True)
            groups.append(group)

    emit(_is_actor, with_mapper=True, with_parts=True)
    emit(lambda lc: "Mapper" in lc.cls, with_mapper=False, with_parts=True)
    emit(lambda lc: True, with_mapper=False, with_parts=False)
    return groups


def _starts(s: ast.stmt) -> bool:
    match s:
        case ast.Expr(value=ast.Call(func=ast.Attribute(attr="Start"))):
            return True
    return False


def group_infrastructure(own: list[Lifecycle]) -> list[list[Lifecycle]]:
    """One group: windows, the interactor (the last one) without its Start(), styles, and Start() at the end."""
    windows = [lc for lc in own if "RenderWindow" in lc.cls and "Interactor" not in lc.cls]
    interactors = [lc for lc in own if "Interactor" in lc.cls and "Style" not in lc.cls]
    group, end = windows, []
    if interactors:
        lc = interactors[-1]
        starts = [s for s in lc.statements if _starts(s)]
        group = group + [replace(lc, statements=[s for s in lc.statements if not _starts(s)], methods=[m for m in lc.methods if m != "Start"])]
        end = [Lifecycle(lc.variable, lc.cls, lc.role, starts[-1:], methods=["Start"])] if starts else []
    styles = [lc for lc in own if lc not in windows and not any(lc is i for i in interactors)]
    group = [*group, *styles, *end]
    return [group] if group else []


def group(lifecycles: list[Lifecycle]) -> list[list[Lifecycle]]:
    """Infrastructure, then properties, then all others alone."""
    of = lambda *roles: [lc for lc in lifecycles if lc.role in roles]
    rest = [[lc] for lc in lifecycles if lc.role not in ("infrastructure", "properties")]
    return group_infrastructure(of("infrastructure")) + group_properties(of("properties")) + rest
