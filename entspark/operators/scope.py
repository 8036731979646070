"""References of Python code, resolved through scopes, imports and the types of receivers.

One pass over the files gives facts: imports, what functions return, and the
references of every entity with what is known locally of the receiver.  They
are resolved in joins, the way of least distance first.  An attribute that holds
an unannotated parameter of the constructor has the type that calls of the
constructor, in any file, pass there: the one of the least file, then of the
least entity, where they differ.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..model import SCOPE_CLASS_TYPES
from ..session import cut

_FACTS = "kind string, file_path string, entity_id string, name string, receiver string, how string, seq int"


def _stem(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def _name(node: ast.AST | None) -> str | None:
    """A type's or constructor's name, if it is one: upper case at first."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        name = node.value.rsplit(".", 1)[-1]
    else:
        name = node.id if isinstance(node, ast.Name) else node.attr if isinstance(node, ast.Attribute) else None
    return name if name and name[:1].isupper() else None


def _value(node: ast.AST, known: dict[str, tuple[str, str]]) -> tuple[str, str] | None:
    """(how, name) of an expression's type: ``type`` of that name, or what the ``call`` of a function returns."""
    if isinstance(node, ast.Await):
        node = node.value
    if isinstance(node, ast.Call):
        if (t := _name(node.func)) is not None:
            return "type", t
        if isinstance(node.func, ast.Name):
            return "call", node.func.id
    if isinstance(node, ast.Name):
        return known.get(node.id)
    return None


def _walk(node: ast.AST) -> Iterator[ast.AST]:
    """In the text's order."""
    todo = [node]
    while todo:
        n = todo.pop()
        yield n
        todo += reversed(list(ast.iter_child_nodes(n)))


def facts(text: str, path: str) -> list[tuple]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return []
    out: list[tuple] = []
    for n in ast.walk(tree):
        if isinstance(n, ast.ImportFrom):
            stem = (n.module or "").rsplit(".", 1)[-1]
            out += [("import", path, None, a.name, a.asname or a.name, stem, 0) for a in n.names]
        elif isinstance(n, ast.Import):
            out += [("import", path, None, "", a.asname or a.name.split(".")[0], a.name.rsplit(".", 1)[-1], 0) for a in n.names]
        elif isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and _name(n.func):
            out += _arguments(n, path)

    def visit(node: ast.AST, parent: str | None, cls: str | None, attrs: dict[str, tuple[str, str]]) -> None:
        for n in getattr(node, "body", []):
            if isinstance(n, ast.ClassDef):
                own = f"{path}::{parent or 'class'}::{n.name}"
                inside: dict[str, tuple[str, str]] = {}
                passed: dict[str, tuple[str, int]] = {}
                for init in n.body:
                    if isinstance(init, ast.AnnAssign) and isinstance(init.target, ast.Name) and (t := _name(init.annotation)):
                        inside[init.target.id] = ("type", t)
                    if isinstance(init, ast.FunctionDef) and init.name == "__init__":
                        known = _params(init)
                        places = _places(init)
                        for s in ast.walk(init):
                            if isinstance(s, ast.Assign | ast.AnnAssign):
                                for target in s.targets if isinstance(s, ast.Assign) else [s.target]:
                                    if isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                                        t = ("type", a) if isinstance(s, ast.AnnAssign) and (a := _name(s.annotation)) else s.value and _value(s.value, known)
                                        if t:
                                            inside[target.attr] = t
                                        elif isinstance(s.value, ast.Name) and s.value.id in places:
                                            passed[target.attr] = (s.value.id, places[s.value.id])
                for attr, (param, place) in passed.items():
                    if attr not in inside:
                        out.append(("param", path, own, param, f"{own}.{attr}", "", place))
                        inside[attr] = ("attr", f"{own}.{attr}")
                for base in n.bases:
                    if (t := _name(base)) is not None:
                        out.append(("ref", path, own, t, None, "name", 0))
                        out.append(("base", path, own, t, None, "", 0))
                visit(n, own, own, inside)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                own = f"{path}::{parent or 'function'}::{n.name}"
                returned = _name(n.returns) or next((t for s in ast.walk(n) if isinstance(s, ast.Return) and s.value is not None and isinstance(s.value, ast.Call) and (t := _name(s.value.func))), None)
                if returned:
                    out.append(("returns", path, own, n.name, returned, "", 0))
                refs(n, own, cls, attrs)
            elif isinstance(n, ast.If | ast.Try | ast.With):
                visit(n, parent, cls, attrs)

    def refs(f: ast.AST, own: str, cls: str | None, attrs: dict[str, tuple[str, str]]) -> None:
        known = _params(f)
        for n in _walk(f):
            if isinstance(n, ast.Assign) and (t := _value(n.value, known)):
                known.update({x.id: t for x in n.targets if isinstance(x, ast.Name)})
            elif isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name) and (a := _name(n.annotation)):
                known[n.target.id] = ("type", a)
        for seq, n in enumerate(_walk(f)):
            if isinstance(n, ast.Call):
                if isinstance(n.func, ast.Name):
                    out.append(("ref", path, own, n.func.id, None, "name", seq))
                elif isinstance(n.func, ast.Attribute):
                    base, member = n.func.value, n.func.attr
                    if isinstance(base, ast.Name) and base.id in ("self", "cls"):
                        out.append(("ref", path, own, member, cls, "class", seq))
                    elif isinstance(base, ast.Call) and isinstance(base.func, ast.Name) and base.func.id == "super":
                        out.append(("ref", path, own, member, cls, "super", seq))
                    elif isinstance(base, ast.Attribute) and isinstance(base.value, ast.Name) and base.value.id == "self":
                        if t := attrs.get(base.attr):
                            out.append(("ref", path, own, member, t[1], t[0], seq))
                    elif t := _value(base, known):
                        out.append(("ref", path, own, member, t[1], t[0], seq))
                    elif isinstance(base, ast.Name):
                        out.append(("ref", path, own, member, base.id, "type" if base.id[:1].isupper() else "module", seq))
            if isinstance(n, ast.arg) and (t := _name(n.annotation)):
                out.append(("ref", path, own, t, None, "name", seq))

    visit(tree, None, None, {})
    return out


def _arguments(call: ast.Call, path: str) -> list[tuple]:
    """Types that a call of a constructor passes: by place, or by a keyword (in ``entity_id``)."""
    plain = next((k for k, a in enumerate(call.args) if isinstance(a, ast.Starred)), len(call.args))
    given = [(None, k, a) for k, a in enumerate(call.args[:plain])] + [(a.arg, -1, a.value) for a in call.keywords if a.arg]
    return [("argument", path, keyword, call.func.id, t[1], t[0], k) for keyword, k, a in given if (t := _value(a, {}))]


def _places(init: ast.FunctionDef) -> dict[str, int]:
    """Unannotated parameters and their places after ``self``, -1 for those passed by keyword alone."""
    a = init.args
    return {p.arg: k for k, p in enumerate([*a.posonlyargs, *a.args][1:]) if p.annotation is None} | {p.arg: -1 for p in a.kwonlyargs if p.annotation is None}


def _params(f: ast.AST) -> dict[str, tuple[str, str]]:
    a = f.args
    return {p.arg: ("type", t) for p in (*a.posonlyargs, *a.args, *a.kwonlyargs) if (t := _name(p.annotation))}


def python_facts(files: DataFrame) -> DataFrame:
    """Facts of (path, content) files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [r for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if text is not None for r in facts(text, path)]
            if rows:
                types = (*(pa.string(),) * 6, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["kind", "file_path", "entity_id", "name", "receiver", "how", "seq"])

    return files.filter(F.endswith(F.col("path"), F.lit(".py"))).select("path", "content").mapInArrow(run, _FACTS)


def import_table(known: DataFrame, entities: DataFrame) -> DataFrame:
    """(file_path, local_name, target) of names imported from another file, by the file's stem."""
    imports = known.filter("kind = 'import' AND name <> ''").select("file_path", F.col("receiver").alias("local_name"), "name", F.col("how").alias("stem"))
    top = entities.filter("parent_id IS NULL").select(F.col("id").alias("target"), "name", T.file_stem("file_path").alias("stem"), F.col("file_path").alias("from_path"))
    return imports.join(top, ["name", "stem"]).filter("from_path <> file_path").groupBy("file_path", "local_name").agg(F.min("target").alias("target"))


def resolve(known: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges (src, dst, ref_type, how) of the references that can be resolved, the first way for each."""
    known, entities = cut(known), cut(entities)
    imports = cut(import_table(known, entities))
    top = entities.filter("parent_id IS NULL").select("file_path", "name", F.col("id").alias("target"), "entity_type")
    everywhere = top.groupBy("name").agg(F.min("target").alias("target"), F.count("*").alias("n"))

    def place(names: DataFrame) -> DataFrame:
        """(key columns, file_path, name) -> the entity a name stands for in a file: its own, an imported, the only or upper-case one."""
        here = top.select("file_path", "name", F.col("target").alias("_1"))
        there = imports.select("file_path", F.col("local_name").alias("name"), F.col("target").alias("_2"))
        other = everywhere.select("name", F.when((F.col("n") == 1) | F.rlike("name", F.lit("^[A-Z]")), F.col("target")).alias("_3"))
        found = names.join(here, ["file_path", "name"], "left").join(there, ["file_path", "name"], "left").join(other, "name", "left")
        way = F.when(F.col("_1").isNotNull(), "scope_chain").when(F.col("_2").isNotNull(), "import").otherwise("global")
        return found.withColumn("target", F.coalesce("_1", "_2", "_3")).withColumn("way", way).filter("target IS NOT NULL").drop("_1", "_2", "_3")

    refs = known.filter("kind = 'ref'").withColumn("key", F.struct("entity_id", "how", "receiver", "name", "seq"))
    plain = place(refs.filter("how = 'name'").select("key", "file_path", "name")).select("key", F.col("target").alias("dst"), "way")
    # receivers become classes
    returns = known.filter("kind = 'returns'").groupBy(F.col("name").alias("receiver")).agg(F.min("receiver").alias("returned"))
    typed = refs.filter("how IN ('type', 'call', 'module')").join(returns, "receiver", "left").withColumn("cls", F.when(F.col("how") == "call", F.col("returned")).otherwise(F.col("receiver")))
    classes = place(typed.filter("cls IS NOT NULL AND how <> 'module'").select("key", "file_path", F.col("cls").alias("name"))).select("key", F.col("target").alias("class_id"), F.lit("type_tracking").alias("way"))
    own = refs.filter("how = 'class'").select("key", F.col("receiver").alias("class_id"), F.lit("scope_chain").alias("way"))
    bases = place(known.filter("kind = 'base'").select("entity_id", "file_path", "name")).select(F.col("entity_id").alias("class_id"), F.col("target").alias("base_id"))
    above = refs.filter("how = 'super'").select("key", F.col("receiver").alias("class_id")).join(bases, "class_id").select("key", F.col("base_id").alias("class_id"), F.lit("scope_chain").alias("way"))
    members = entities.join(entities.filter(F.col("entity_type").isin(*SCOPE_CLASS_TYPES)).select(F.col("id").alias("class_id")), F.col("parent_id") == F.col("class_id")).select("class_id", F.col("name").alias("member"), F.col("id").alias("dst"))
    # attributes that hold what calls of the constructor pass
    given = known.filter("kind = 'argument'").join(returns, "receiver", "left").select("file_path", "name", F.when(F.col("how") == "call", F.col("returned")).otherwise(F.col("receiver")).alias("given"), F.coalesce("entity_id", F.col("seq").cast("string")).alias("slot"))
    built = place(given.filter("given IS NOT NULL").distinct()).select("file_path", F.col("given").alias("name"), "slot", F.col("target").alias("class_id"))
    params = known.filter("kind = 'param'").select(F.col("entity_id").alias("class_id"), "receiver", F.explode(F.array("name", F.col("seq").cast("string"))).alias("slot")).filter("slot <> '-1'")
    held = place(built.join(params, ["class_id", "slot"]).select("receiver", "file_path", "name")).groupBy("receiver").agg(F.min(F.struct("file_path", "target"))["target"].alias("class_id"))
    passed = refs.filter("how = 'attr'").join(held, "receiver").select("key", "class_id", F.lit("type_tracking").alias("way"))
    receivers = classes.unionByName(own).unionByName(above).unionByName(passed).withColumn("distance", F.lit(0))
    receivers = cut(receivers)
    inherited = receivers.join(bases, "class_id").select("key", F.col("base_id").alias("class_id"), "way", F.lit(1).alias("distance"))
    methods = cut(receivers.unionByName(inherited)).withColumn("member", F.col("key.name")).join(members, ["class_id", "member"])
    first = F.row_number().over(W.partitionBy("key").orderBy("distance", "dst"))
    methods = methods.withColumn("_rn", first).filter("_rn = 1").select("key", "dst", "way")
    # module.function
    modules = known.filter("kind = 'import' AND name = ''").select("file_path", "receiver", F.col("how").alias("stem"))
    functions = entities.filter("parent_id IS NULL").select(T.file_stem("file_path").alias("stem"), "name", F.col("id").alias("dst"))
    through = refs.filter("how = 'module'").select("key", "file_path", "receiver", "name").join(modules, ["file_path", "receiver"]).join(functions, ["stem", "name"]).select("key", "dst", F.lit("import").alias("way"))
    found = plain.unionByName(methods).unionByName(through).select(F.col("key.entity_id").alias("src"), "dst", F.col("key.how").alias("how"), F.col("key.name").alias("name"), F.col("key.seq").alias("seq"), "way")
    kind = F.when((F.col("how") == "name") & F.rlike("name", F.lit("^[A-Z]")), "typeref").otherwise("calls")
    rank = F.row_number().over(W.partitionBy("src", "dst").orderBy("seq", "how"))
    return found.filter("src <> dst").withColumn("_rn", rank).filter("_rn = 1").select("src", "dst", kind.alias("ref_type"), "way")


def resolution_log(known: DataFrame, resolved: DataFrame) -> DataFrame:
    """Each entity's references by name, with how one of them was resolved, or ``unresolved``."""
    refs = known.filter("kind = 'ref'").select(F.col("entity_id").alias("from_entity"), "name").distinct()
    hit = resolved.select(F.col("src").alias("from_entity"), F.element_at(F.split("dst", "::"), -1).alias("name"), F.col("dst").alias("resolved_to"), "way")
    return refs.join(hit, ["from_entity", "name"], "left").select("from_entity", F.col("name").alias("reference"), "resolved_to", F.coalesce("way", F.lit("unresolved")).alias("method"))
