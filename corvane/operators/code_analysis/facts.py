"""What a scope does with API objects: one walk over its statements."""

from __future__ import annotations

import ast
from collections import defaultdict
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from ...functions.fixed import ACTOR_LIKE, OTHER_GETTERS, PREFIX, PROPERTY_GETTERS, PROPERTY_SETTERS

Call = tuple[str, list[str]]


def reference(node: ast.AST | None) -> str | None:
    """Name of a plain variable, or `self.x`."""
    match node:
        case ast.Name(id=name):
            return name
        case ast.Attribute(value=ast.Name(id="self"), attr=attr):
            return f"self.{attr}"
    return None


def setter(name: str) -> str:
    """Setter of an attribute or keyword: only the first letter is a capital."""
    return "Set" + name.capitalize()


@dataclass
class Facts:
    """Facts of one scope. Insertion orders matter: they are the order of chunks."""

    classes: dict[str, str] = field(default_factory=dict)
    statements: dict[str, list[ast.stmt]] = field(default_factory=lambda: defaultdict(list))
    calls: dict[str, list[Call]] = field(default_factory=lambda: defaultdict(list))
    statics: dict[str, list[ast.stmt]] = field(default_factory=lambda: defaultdict(list))
    mapper_of: dict[str, str] = field(default_factory=dict)
    actor_of: dict[str, str] = field(default_factory=dict)
    owners: dict[str, str] = field(default_factory=dict)
    properties: dict[str, list[str]] = field(default_factory=lambda: defaultdict(list))
    inline: set[str] = field(default_factory=set)

    def owns(self, parent: str, prop: str) -> None:
        self.owners[prop] = parent
        self.properties[parent].append(prop)

    def relate(self, var: str, method: str, other: str | None) -> None:
        """Links by SetMapper (the last one counts for an actor) and property setters."""
        if other and method == "SetMapper":
            self.actor_of[other], self.mapper_of[var] = var, other
        elif other and method in PROPERTY_SETTERS:
            self.owns(var, other)

    def called(self, var: str, method: str, args: list[str], at: ast.stmt, other: str | None) -> None:
        self.statements[var].append(at)
        self.calls[var].append((method, args))
        self.relate(var, method, other)


class ScopeWalker(ast.NodeVisitor):
    """Fills Facts. known says whether a name is a class of the API; helpers are functions of the file.

    Assignments count when their value is a call or their target an attribute. Results of getters aren't objects of
    their own, and calls on instances inside assignments belong to no lifecycle.
    """

    def __init__(self, known: Callable[[str], bool], helpers: Iterable[str], classes: dict[str, str] | None = None):
        self.known, self.helpers = known, set(helpers)
        self.facts = Facts(classes=dict(classes or {}))

    def _api(self, name: str) -> bool:
        return name.startswith(PREFIX) and self.known(name)

    def visit_Assign(self, node: ast.Assign) -> None:
        match node.value:
            case ast.Call(func=ast.Attribute(value=ast.Name(id=base), attr=attr)):
                if base == PREFIX:
                    if self.known(attr):
                        self._bind(node, attr)
                elif self._api(base):
                    self.facts.statics[base].append(node)
            case ast.Call(func=ast.Name(id=name), keywords=keywords) if name not in self.helpers and self._api(name):
                self._bind(node, name, keywords)
        for target in node.targets:
            self._link(target, node)
        self.generic_visit(node)

    def _bind(self, node: ast.Assign, cls: str, keywords: Iterable[ast.keyword] = ()) -> None:
        for var in filter(None, map(reference, node.targets)):
            self.facts.classes[var] = cls
            self.facts.statements[var].append(node)
            for k in keywords:
                if k.arg is not None:
                    self.facts.calls[var].append((setter(k.arg), [ast.unparse(k.value)]))
                    if "Actor" in cls or cls in ACTOR_LIKE:
                        self.facts.relate(var, setter(k.arg), reference(k.value))

    def _link(self, target: ast.expr, node: ast.Assign) -> None:
        facts = self.facts
        match target, node.value:
            case ast.Name(id=prop), ast.Call(func=ast.Attribute(value=ast.Name(id=parent), attr=getter)) if getter in PROPERTY_GETTERS:
                facts.owns(parent, prop)
            case ast.Attribute(value=ast.Name(id=var), attr=attr), value if var in facts.classes:
                other = value.id if isinstance(value, ast.Name) and value.id in facts.classes else None
                facts.called(var, setter(attr), [ast.unparse(value)], node, other)

    def visit_Expr(self, node: ast.Expr) -> None:
        facts = self.facts
        match node.value:
            case ast.Call(func=ast.Attribute(value=ast.Call(func=ast.Attribute(value=ast.Name(id=var), attr=getter)))):
                if var in facts.classes and (getter in PROPERTY_GETTERS or getter in OTHER_GETTERS):
                    facts.statements[var].append(node)
                    if getter in PROPERTY_GETTERS:
                        facts.inline.add(var)
            case ast.Call(func=ast.Attribute(value=ast.Name() | ast.Attribute() as base, attr=method), args=args):
                var = reference(base)
                if var in facts.classes:
                    facts.called(var, method, list(map(ast.unparse, args)), node, reference(args[0]) if args else None)
                elif isinstance(base, ast.Name) and self._api(base.id):
                    facts.statics[base.id].append(node)
        self.generic_visit(node)

    def visit_For(self, node: ast.For) -> None:
        """A loop that uses attributes of one object only is a statement of that object; else its body is walked."""
        used = {v for stmt in node.body for x in ast.walk(stmt) if isinstance(x, ast.Attribute) and (v := reference(x.value)) in self.facts.classes}
        if len(used) == 1:
            self.facts.statements[used.pop()].append(node)
        else:
            for stmt in node.body:
                self.visit(stmt)


def instance_classes(node: ast.ClassDef, known: Callable[[str], bool]) -> dict[str, str]:
    """`self.x` to class, from plain constructor calls in the methods of a class."""
    out = {}
    for method in node.body:
        if isinstance(method, ast.FunctionDef):
            for stmt in ast.walk(method):
                match stmt:
                    case ast.Assign(targets=targets, value=ast.Call(func=ast.Name(id=name))) if name.startswith(PREFIX) and known(name):
                        out |= {ref: name for t in targets if isinstance(t, ast.Attribute) and (ref := reference(t))}
    return out
