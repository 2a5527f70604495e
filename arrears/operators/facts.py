"""Typed facts from Python source: each file is parsed once, every rule is a query on the rows.

This is the only Python worker of the library; it is a per-file step without shuffle.
"""

import ast
import gc
import hashlib
import re
from collections import deque
from operator import attrgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrears import constants as C
from arrears.functions import paths
from arrears.operators.common import stage

FACTS = ("repo_id string, path string, kind string, name string, line int, ord int, group_ord int, "
         "n1 int, n2 int, flag boolean, text string")

_ARROW = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_SCHEMA = pa.schema([(name, _ARROW[kind]) for name, kind in (part.split() for part in FACTS.split(", "))])
_WORD = re.compile(r"\w+")
_ASCII_NAME = re.compile(r"\b[A-Za-z_]\w*", re.ASCII)
_GENERIC = frozenset(C.GENERIC_NAMES)
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_LOOPS = (ast.For, ast.While)
_SCOPES = {*_DEFS, ast.ClassDef}
_ONE_POINT = {ast.If, ast.IfExp, ast.Assert}
_ITERATIONS = {ast.For, ast.AsyncFor, ast.While}
_TRIES = {ast.Try, ast.TryStar}
_CLOSE = object()
_PIECE = 5_000  # facts per batch that leaves the worker
_JUMPS = (ast.Return, ast.Raise, ast.Continue, ast.Break)

_BODIES = {ast.Module, *_SCOPES, *_ITERATIONS, *_TRIES, ast.If, ast.With, ast.AsyncWith, ast.ExceptHandler, ast.match_case}
_SEEN = {*_BODIES, ast.Import, ast.ImportFrom}

# Fields that hold names, numbers, contexts and operators: no rule reads what is below them.
_PLAIN = {"id", "name", "names", "attr", "arg", "asname", "module", "level", "ctx", "op", "ops", "kind", "type_comment",
          "conversion", "simple", "is_async", "rest", "kwd_attrs", "tag", "type_ignores"}


def _kinds(base=ast.AST):
    for kind in base.__subclasses__():
        yield kind
        yield from _kinds(kind)


def _getter(names):
    """The named attributes of a node as a tuple, None without names."""
    if len(names) == 1:
        name = names[0]
        return lambda node: (getattr(node, name),)
    return attrgetter(*names) if names else None


# Per node type: what holds its children, and its opening and fields (last first) in a fingerprint.
_CHILDREN = {kind: _getter([] if kind is ast.Constant else [n for n in kind._fields if n not in _PLAIN]) for kind in _kinds()}
_SHAPES = {kind: (f"({kind.__name__}", _getter(kind._fields[::-1])) for kind in _kinds()}


def _children(node):
    """Child nodes in order, without names' contexts, operators and aliases; None where a list of nodes has gaps."""
    get = _CHILDREN[type(node)]
    if get is not None:
        for value in get(node):
            if type(value) is list:
                yield from value
            else:
                yield value


def _walk(root):
    """The node and all below it, level by level."""
    pending = deque((root,))
    while pending:
        node = pending.popleft()
        if node is None:
            continue
        yield node
        get = _CHILDREN[type(node)]
        if get is not None:
            for value in get(node):
                if type(value) is list:
                    pending.extend(value)
                elif value is not None:
                    pending.append(value)


def _decisions(nodes) -> int:
    """McCabe points below the nodes; nested functions and classes count on their own."""
    points, pending = 0, list(nodes)
    while pending:
        node = pending.pop()
        kind = type(node)
        get = _CHILDREN.get(kind)
        if get is None or kind in _SCOPES:
            continue
        if kind in _ONE_POINT:
            points += 1
        elif kind in _ITERATIONS:
            points += 1 + bool(node.orelse)
        elif kind in _TRIES:
            points += len(node.handlers) + bool(node.orelse)
        elif kind is ast.BoolOp:
            points += len(node.values) - 1
        elif kind is ast.comprehension:
            points += 1 + len(node.ifs)
        elif kind is ast.Match:
            wildcard = any(getattr(case.pattern, "pattern", False) is None for case in node.cases)
            points += max(0, len(node.cases) - wildcard)
        for value in get(node):
            if type(value) is list:
                pending.extend(value)
            elif value is not None:
                pending.append(value)
    return points


def _measured(tree) -> set:
    """Functions that count for complexity: at column 0, or directly in a class outside functions."""
    found, pending = set(), list(tree.body)
    while pending:
        node = pending.pop()
        if isinstance(node, _DEFS):
            if node.col_offset == 0:
                found.add(node)
        elif isinstance(node, ast.ClassDef):
            found.update(item for item in node.body if isinstance(item, _DEFS))
        elif node is not None:
            pending.extend(_children(node))
    return found


def _scalar(value) -> str:
    # Numbers of any length; repr refuses very long ones.
    shown = f"{value:x}" if type(value) is int else repr(value)
    return f"{type(value).__name__} {shown};"


def _fingerprint(body: list) -> str:
    """Digest of the structure of statements, without positions; any nesting depth."""
    out, pending = [], [body]
    add, push, extend = out.append, pending.append, pending.extend
    while pending:
        item = pending.pop()
        kind = type(item)
        if kind is ast.Name:
            add(f"(Namestr {item.id!r};({type(item.ctx).__name__}))")
        elif kind is ast.Constant:
            add(f"(Constant{_scalar(item.value)}{_scalar(item.kind)})")
        elif kind is list:
            if item:
                add("[")
                push(_CLOSE)
                extend(item[::-1])
            else:
                add("[)")
        elif item is _CLOSE:
            add(")")
        elif item is None:
            add("NoneType None;")
        elif kind in _SHAPES:
            opening, get = _SHAPES[kind]
            add(opening)
            if get is None:
                add(")")
            else:
                push(_CLOSE)
                extend(get(item))
        else:
            add(_scalar(item))
    return hashlib.sha256("".join(out).encode("utf-8", "surrogatepass")).hexdigest()


def _function_fact(node, measured):
    mutable = any(isinstance(d, (ast.List, ast.Dict, ast.Set)) for d in node.args.defaults)
    return dict(kind="function", name=node.name, line=node.lineno,
                n1=1 + _decisions(node.body) if node in measured else None, n2=len(node.body),
                flag=ast.get_docstring(node, clean=False) is not None, group_ord=int(mutable),
                text=_fingerprint(node.body))


def _loop_facts(loop, number):
    for order, child in enumerate(_walk(loop)):
        name, target = None, None
        if child is loop:
            continue
        if isinstance(child, _LOOPS):
            name = "nested_loop"
        elif (isinstance(child, ast.Call) and isinstance(child.func, ast.Attribute)
              and child.func.attr == "append" and isinstance(child.func.value, ast.BinOp)):
            name = "append_on_expression_in_loop"
        elif (isinstance(child, ast.AugAssign) and isinstance(child.op, ast.Add)
              and isinstance(child.target, ast.Name)):
            name, target = "accumulation_in_loop", child.target.id
        if name:
            yield dict(kind="in_loop", name=name, line=child.lineno, ord=order, group_ord=number,
                       text=target)


def _file_facts(source: str):
    """Fact rows of one parsed file; a file that does not parse yields that it does not."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, MemoryError, RecursionError) as error:
        yield dict(kind="parse_error", name=type(error).__name__)
        return
    measured = _measured(tree)
    functions = has_try = 0
    for number, node in enumerate(_walk(tree)):
        kind = type(node)
        if kind is ast.Name:
            if node.id.startswith("_") and type(node.ctx) is ast.Load:
                yield dict(kind="name_load", name=node.id)
            continue
        if kind not in _SEEN:
            continue
        if kind in _DEFS:
            functions += 1
            yield _function_fact(node, measured)
        elif kind is ast.ClassDef:
            yield dict(kind="class", name=node.name, line=node.lineno,
                       flag=ast.get_docstring(node, clean=False) is not None)
        elif kind is ast.Import:
            for alias in node.names:
                yield dict(kind="import", name=alias.name, line=node.lineno)
        elif kind is ast.ImportFrom:
            if node.module:
                yield dict(kind="import", name=node.module, line=node.lineno)
        elif kind is ast.Try:
            has_try = 1
            for handler in node.handlers:
                name = "bare" if handler.type is None else getattr(handler.type, "id", "other")
                silent = bool(handler.body) and all(isinstance(s, ast.Pass) for s in handler.body)
                yield dict(kind="handler", name=name, line=handler.lineno, flag=silent)
        elif kind in _LOOPS:
            yield from _loop_facts(node, number)
        if kind in _BODIES:
            body = node.body
            for index, stmt in enumerate(body[:-1]):
                if isinstance(stmt, _JUMPS):
                    yield dict(kind="after_jump", line=body[index + 1].lineno, ord=index,
                               group_ord=number)
    for node in tree.body:
        if isinstance(node, _DEFS) and node.name.startswith("_") and node.name[:2] != "__":
            yield dict(kind="private_function", name=node.name, line=node.lineno)
    yield dict(kind="file", n1=len(source.splitlines()), n2=functions, flag=bool(has_try))


def _word_fact(source: str) -> dict:
    """Identifier words of the text and how many of them are generic names."""
    if source.isascii():
        words = _ASCII_NAME.findall(source)
    else:
        words = [w for w in _WORD.findall(source) if w.isascii() and not w[0].isdigit()]
    return dict(kind="words", n1=len(words), n2=sum(map(_GENERIC.__contains__, words)))


def _all_facts(source: str | None):
    """All facts of a file; a file without text is counted as one that does not parse."""
    if source is None:
        yield dict(kind="parse_error", name="null")
        return
    yield _word_fact(source)
    yield from _file_facts(source)


def _parse(batches):
    gc.disable()  # syntax trees have no cycles; what else has some goes after each batch
    try:
        yield from _parsed(batches)
    finally:
        gc.enable()


def _parsed(batches):
    fields = _SCHEMA.names[2:]
    for batch in batches:
        rows = []
        for repo, path, text in zip(*[column.to_pylist() for column in batch.columns]):
            for fact in _all_facts(text):
                rows.append((repo, path, *map(fact.get, fields)))
                if len(rows) >= _PIECE:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)
        gc.collect()


def _batch(rows):
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


def python_facts(source_files: DataFrame) -> DataFrame:
    """Facts of all Python files outside excluded folders.

    Only the columns the parser needs reach the Python worker. Callers that run several rules use
    ``staged_facts``: the facts are far smaller than the text.
    """
    path = F.col("path")
    return (source_files.filter(path.endswith(".py") & ~paths.under_skip_dir(path))
            .select("repo_id", "path", "text").mapInArrow(_parse, FACTS))


def staged_facts(source_files: DataFrame) -> DataFrame:
    """Facts written once, ordered by kind: each rule skips the pages of the other kinds."""
    return stage(python_facts(source_files), ("kind",))


def scanned(facts: DataFrame, kind: str) -> DataFrame:
    """Facts of one kind outside generated and lock files (structure rules read those as well)."""
    return facts.filter((F.col("kind") == kind) & ~paths.is_skipped_file(F.col("path")))
