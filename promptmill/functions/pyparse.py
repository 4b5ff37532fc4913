"""Arrow UDFs around Python's own parser, the one thing Spark has no expression for.

Each UDF maps one text to one small value. Counting, clipping and summing what they
emit is left to Spark.
"""

from __future__ import annotations

import ast
from collections.abc import Callable
import hashlib
import sys
import warnings

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Ship these functions with the job, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STRUCTURE = T.StructType(
    [T.StructField("parses", T.BooleanType())]
    + [T.StructField(name, T.ArrayType(T.StringType())) for name in ("subtrees", "edges")]
)


def parse_python(code: str | None) -> ast.Module | None:
    """The syntax tree, or None. Any parser failure counts as "does not parse"."""
    if code is None:
        return None
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(code)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def subtree_signatures(tree: ast.AST) -> list[str]:
    """One digest per inner node: its type and the shapes below it, names left out.

    Digests are built bottom-up, so the work is linear in the size of the tree.
    """
    nodes, below = [tree], []
    for node in nodes:  # parents first; the list grows while it is read
        children = list(ast.iter_child_nodes(node))
        below.append((len(nodes), len(nodes) + len(children)))
        nodes.extend(children)
    shapes = [type(node).__name__ for node in nodes]
    inner = []
    for i in range(len(nodes) - 1, -1, -1):
        start, end = below[i]
        if start < end:
            text = f"{shapes[i]}({' '.join(shapes[start:end])})"
            shapes[i] = hashlib.blake2b(text.encode(), digest_size=8).hexdigest()
            inner.append(shapes[i])
    return inner


def _names(node: ast.AST | None, context: type) -> list[str]:
    if node is None:
        return []
    return [n.id for n in ast.walk(node) if isinstance(n, ast.Name) and isinstance(n.ctx, context)]


_SCOPES = (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda, ast.ClassDef)
_COMPREHENSIONS = (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)


def _assigned(body: list[ast.stmt]) -> set[str]:
    """Names a scope binds (its locals), not looking into nested scopes."""
    found: set[str] = set()
    pending: list[ast.AST] = list(body)
    while pending:
        node = pending.pop()
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Store):
            found.add(node.id)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.add(node.name)
            pending.extend(node.decorator_list)
            continue
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            found.update(a.asname or a.name.partition(".")[0] for a in node.names)
        elif isinstance(node, ast.ExceptHandler) and node.name:
            found.add(node.name)
        elif isinstance(node, (ast.Lambda, *_COMPREHENSIONS)):
            continue
        pending.extend(ast.iter_child_nodes(node))
    return found


class _Flow:
    """Reaching definitions of one scope: a state maps a name to the definitions that reach here.

    Branches are joined (union), loops run to a fixed point with edges held back, and only the
    last pass over a loop body records edges. ``return``, ``raise``, ``break`` and ``continue``
    end a path; breaks join the loop's exit, continues its head.
    """

    def __init__(self, label, edges: list[str], outer: dict[str, frozenset] | None, local: set[str]) -> None:
        self.label, self.edges, self.outer, self.local = label, edges, outer or {}, local
        self.quiet = 0
        self.breaks: list[list[dict]] = []
        self.continues: list[list[dict]] = []

    @staticmethod
    def new(node: ast.AST, name: str) -> frozenset:
        """The definition of ``name`` by ``node``: the same on every pass over a loop."""
        return frozenset([(id(node), name)])

    def emit(self, edge: str) -> None:
        if not self.quiet:
            self.edges.append(edge)

    def read(self, state: dict | None, names: list[str]) -> None:
        for name in names:
            # Bound here (or in a comprehension here): this scope's state; else the enclosing one's.
            here = state or {}
            reaching = here.get(name) if name in here or name in self.local else self.outer.get(name)
            if reaching:
                self.emit(f"{self.label(name)} comesFrom " + ",".join([self.label(name)] * len(reaching)))

    def write(self, state: dict | None, targets: list[str], sources: list[str], node: ast.AST) -> dict | None:
        if state is None:
            return None
        origin = ",".join(self.label(n) for n in sources)
        state = dict(state)
        for target in targets:
            self.emit(f"{self.label(target)} computedFrom {origin}")
            state[target] = self.new(node, target)
        return state

    @staticmethod
    def join(*states: dict | None) -> dict | None:
        live = [s for s in states if s is not None]
        if not live:
            return None
        out: dict[str, frozenset] = {}
        for state in live:
            for name, defs in state.items():
                out[name] = out.get(name, frozenset()) | defs
        return out

    def expression(self, state: dict | None, node: ast.AST | None) -> None:
        """Reads of an expression in evaluation order; comprehensions, lambdas and := bind their names."""
        if node is None or state is None:
            return
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            self.read(state, [node.id])
            return
        if isinstance(node, ast.NamedExpr):
            self.expression(state, node.value)
            state.update(self.write(state, [node.target.id], _names(node.value, ast.Load), node) or {})
            return
        if isinstance(node, _COMPREHENSIONS):
            inner = dict(state)
            for part in node.generators:
                self.expression(inner, part.iter)
                inner = self.write(inner, _names(part.target, ast.Store), _names(part.iter, ast.Load), part)
                for test in part.ifs:
                    self.expression(inner, test)
            for part in ("key", "value", "elt"):
                self.expression(inner, getattr(node, part, None))
            return
        if isinstance(node, ast.Lambda):
            self.scope(state, node.args, [node.body])
            return
        for child in ast.iter_child_nodes(node):
            self.expression(state, child)

    def scope(self, state: dict | None, args: ast.arguments | None, body: list[ast.AST]) -> None:
        """A nested function, lambda or class body: its own locals, the enclosing state as closure."""
        names = [a.arg for a in (args.posonlyargs + args.args + args.kwonlyargs) if args] if args else []
        if args and args.vararg:
            names.append(args.vararg.arg)
        if args and args.kwarg:
            names.append(args.kwarg.arg)
        statements = [b for b in body if isinstance(b, ast.stmt)]
        local = _assigned(statements) | set(names)
        closure = {**self.outer, **{k: v for k, v in (state or {}).items() if k in self.local}}
        inner = _Flow(self.label, self.edges, closure, local)
        inner.quiet = self.quiet
        start = {}
        for name in names:
            self.label(name)
            start[name] = inner.new(args, name)
        expressions = [b for b in body if not isinstance(b, ast.stmt)]
        for expression in expressions:
            inner.expression(start, expression)
        inner.block(start, statements)

    def block(self, state: dict | None, body: list[ast.stmt]) -> dict | None:
        for statement in body:
            state = self.statement(state, statement)
        return state

    def loop(self, state: dict | None, head: Callable[[dict | None], dict | None], body: list[ast.stmt]) -> tuple:
        """State at the loop's exit (before ``else``) and after breaks."""
        entry = state
        self.quiet += 1
        for _ in range(64):
            self.breaks.append([])
            self.continues.append([])
            after = self.block(head(entry), body)
            self.breaks.pop()
            again = self.join(state, after, *self.continues.pop())
            if again == entry:
                break
            entry = again
        self.quiet -= 1
        self.breaks.append([])
        self.continues.append([])
        after = self.block(head(entry), body)
        broken = self.breaks.pop()
        self.continues.pop()
        return self.join(entry, after), self.join(*broken) if broken else None

    def statement(self, state: dict | None, node: ast.stmt) -> dict | None:
        if state is None:
            return None
        if isinstance(node, (ast.Assign, ast.AnnAssign, ast.AugAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            stored = [name for target in targets for name in _names(target, ast.Store)]
            sources = _names(node.value, ast.Load) if node.value else []
            if isinstance(node, ast.AugAssign):
                self.read(state, stored)
                sources = stored + sources
            state = dict(state)
            self.expression(state, node.value)
            return self.write(state, stored, sources, node) if node.value is not None else state
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            for decorator in node.decorator_list:
                self.expression(state, decorator)
            if isinstance(node, ast.ClassDef):
                for base in node.bases:
                    self.expression(state, base)
            state = dict(state)
            state[node.name] = self.new(node, node.name)
            self.scope(state, None if isinstance(node, ast.ClassDef) else node.args, node.body)
            return state
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            state = dict(state)
            for alias in node.names:
                name = alias.asname or alias.name.partition(".")[0]
                self.label(name)
                state[name] = self.new(node, name)
            return state
        if isinstance(node, ast.If):
            self.expression(state, node.test)
            return self.join(self.block(dict(state), node.body), self.block(dict(state), node.orelse))
        if isinstance(node, (ast.For, ast.AsyncFor)):
            self.expression(state, node.iter)
            sources = _names(node.iter, ast.Load)

            def head(entry):
                return self.write(entry, _names(node.target, ast.Store), sources, node)

            exit_state, broken = self.loop(state, head, node.body)
            return self.join(self.block(exit_state, node.orelse), broken)
        if isinstance(node, ast.While):

            def head(entry):
                self.expression(entry, node.test)
                return dict(entry) if entry is not None else None

            exit_state, broken = self.loop(state, head, node.body)
            return self.join(self.block(exit_state, node.orelse), broken)
        if isinstance(node, (ast.With, ast.AsyncWith)):
            for item in node.items:
                self.expression(state, item.context_expr)
                state = self.write(state, _names(item.optional_vars, ast.Store), _names(item.context_expr, ast.Load), item)
            return self.block(state, node.body)
        if isinstance(node, (ast.Try, getattr(ast, "TryStar", ast.Try))):
            tried = self.block(dict(state), node.body)
            # A handler may start anywhere in the body: from before or after it.
            begun = self.join(state, tried)
            handled = []
            for handler in node.handlers:
                self.expression(begun, handler.type)
                entry = self.write(begun, [handler.name] if handler.name else [], _names(handler.type, ast.Load), handler)
                handled.append(self.block(entry, handler.body))
            done = self.join(self.block(tried, node.orelse), *handled)
            return self.block(done, node.finalbody) if node.finalbody else done
        if isinstance(node, (ast.Return, ast.Raise)):
            for child in ast.iter_child_nodes(node):
                self.expression(state, child)
            return None
        if isinstance(node, ast.Break):
            if self.breaks:
                self.breaks[-1].append(state)
            return None
        if isinstance(node, ast.Continue):
            if self.continues:
                self.continues[-1].append(state)
            return None
        if isinstance(node, ast.Delete):
            state = dict(state)
            for target in node.targets:
                for name in _names(target, ast.Del):
                    state.pop(name, None)
            return state
        state = dict(state)
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.stmt):
                state = self.statement(state, child)
            else:
                self.expression(state, child)
        return state


def dataflow_edges(tree: ast.AST) -> list[str]:
    """Where values come from, as text edges over variables numbered by first use.

    A target is ``computedFrom`` the variables read on its right-hand side. A read ``comesFrom``
    the definitions that reach it (reaching definitions): one source per reaching definition,
    so a name set in both branches of an ``if`` comes from two. Each function, lambda, class and
    comprehension is a scope of its own; names it binds are local (shadowing outer ones), other
    names come from the enclosing state where the scope is defined. Loops carry definitions
    round to a fixed point; a read with no definition reaching it (a builtin, a global set
    elsewhere) has no edge.
    """
    number: dict[str, int] = {}
    edges: list[str] = []

    def label(name: str) -> str:
        return f"var_{number.setdefault(name, len(number))}"

    body = tree.body if isinstance(tree, ast.Module) else [tree]
    flow = _Flow(label, edges, None, _assigned(body))
    flow.block({}, body)
    return edges


@F.pandas_udf(T.BooleanType())
def is_valid_python(code: pd.Series) -> pd.Series:
    return code.map(lambda text: parse_python(text) is not None).astype(bool)


@F.pandas_udf(STRUCTURE)
def code_structure(code: pd.Series) -> pd.DataFrame:
    """Whether a text parses, its subtree digests and data-flow edges; empty if it does not."""
    trees = [parse_python(text) for text in code]
    return pd.DataFrame(
        {
            "parses": [tree is not None for tree in trees],
            "subtrees": [subtree_signatures(tree) if tree else [] for tree in trees],
            "edges": [dataflow_edges(tree) if tree else [] for tree in trees],
        }
    )
