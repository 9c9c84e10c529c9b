"""Grouped lifecycles of a whole file, as plain rows."""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator, Mapping
from typing import Any

from .facts import ScopeWalker, instance_classes
from .lifecycles import Lifecycle, build, group, merge


def analyse(code: str, roles: Mapping[str, str]) -> Iterator[tuple[str | None, list[Lifecycle]]]:
    """(helper function or None, group) of a file: functions, then the module, then classes. roles: of all classes of the API.

    Raises SyntaxError for code that doesn't parse.
    """
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SyntaxWarning)
        tree = ast.parse(code)
    known, role = roles.__contains__, lambda cls: roles.get(cls) or "utility"
    functions = {n.name: n for n in tree.body if isinstance(n, ast.FunctionDef)}
    helpers = set(functions) - {"main"}

    def scope(body: list[ast.stmt], classes: dict[str, str] | None = None) -> list[Lifecycle]:
        walker = ScopeWalker(known, helpers, classes)
        for stmt in body:
            walker.visit(stmt)
        return build(walker.facts, role)

    for name, node in functions.items():
        for g in group(scope(node.body)):
            yield (None if name == "main" else name), g
    module = [n for n in tree.body if not isinstance(n, (ast.FunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))]
    for g in group(scope(module)):
        yield None, g
    for node in tree.body:
        if isinstance(node, ast.ClassDef) and (classes := instance_classes(node, known)):
            methods = [n for n in node.body if isinstance(n, ast.FunctionDef)]
            for g in group(merge(lc for m in methods for lc in scope(m.body, classes))):
                yield None, g


def rows(example_id: str, code: str, roles: Mapping[str, str]) -> Iterator[dict[str, Any]]:
    """A row a chunk; a file that can't be analysed gives one row with an error instead."""
    try:
        found = list(analyse(code, roles))
    except (SyntaxError, ValueError, RecursionError) as e:
        yield {"example_id": example_id, "chunk_no": None, "helper": None, "members": [], "error": f"{type(e).__name__}: {e}"}
        return
    lines = re.split(rb"(?<=\n)|(?<=\r)(?!\n)", code.encode()) if found else []
    for n, (helper, members) in enumerate(found, 1):
        yield {"example_id": example_id, "chunk_no": n, "helper": helper, "members": [member(lc, lines) for lc in members], "error": None}


def segment(lines: list[bytes], s: ast.stmt) -> str:
    """ast.get_source_segment() of lines that are split once for all statements of a file."""
    a, b = s.lineno - 1, (s.end_lineno or s.lineno) - 1
    if a == b:
        return lines[a][s.col_offset : s.end_col_offset].decode()
    return b"".join([lines[a][s.col_offset :], *lines[a + 1 : b], lines[b][: s.end_col_offset]]).decode()


def member(lc: Lifecycle, lines: list[bytes]) -> dict[str, Any]:
    return {
        "variable": lc.variable, "class": lc.cls, "role": lc.role, "mapper": lc.mapper, "actor": lc.actor,
        "properties": [{"variable": v, "class": c} for v, c in lc.properties], "methods": lc.methods,
        "calls": [{"name": m, "args": a} for m, a in lc.calls], "source": [t for s in lc.statements if (t := segment(lines, s))],
    }
