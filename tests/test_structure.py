"""Block trees and reaching assignments: random nested code against a walk over its control flow, and layouts."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from procweave.operators import edge_cases as ec
from procweave.operators import extract, plsql, structure
from procweave.operators.code import coded, items_of, restored, up_to_close

SPACES = [" ", "\n", "\t", "\r\n", " -- END IF; BEGIN\n", " /* ELSE ' \n*/ ", "\n\n  "]


class Program:
    """Random nested code: its text, and the edges of its control flow, made from the same tree but not from the text."""

    def __init__(self, seed, plsql_):
        self.random, self.plsql, self.words, self.edges, self.defs, self.uses = random.Random(seed), plsql_, [], {}, {}, []
        self.start, entry = self.node(), self.node()
        self.edge(self.start, entry)
        body = self.statements(3)
        self.emit("BEGIN")
        last = self.run(body, [entry], None, [])
        self.emit("END", ";")
        del last

    def node(self):
        self.edges[len(self.edges)] = []
        return len(self.edges) - 1

    def edge(self, a, b):
        self.edges[a].append(b)

    def emit(self, *words):
        self.words += words

    def text(self):
        out = "PROCEDURE p IS\n" if self.plsql else "CREATE PROC p @c INT AS\n"
        for w in self.words:
            out += ("" if w == ";" else self.random.choice(SPACES)) + w
        return out

    def statements(self, deep, loop=False):
        kinds = ["def", "def", "use", "other"] + (["if", "if", "ifelse", "loop", "try"] if deep else []) + (["case"] if deep and self.plsql else []) + (["leave", "again"] if loop else []) + ["return"] * (self.random.random() < 0.3)
        return [self.statement(self.random.choice(kinds), deep, loop) for _ in range(self.random.randint(1, 4))]

    def statement(self, kind, deep, loop):
        more = lambda n, inner=loop: [self.statements(deep - 1, inner) for _ in range(n)]
        if kind in ("if", "ifelse"):
            arms = 1 if not self.plsql else self.random.randint(1, 3)
            return kind, more(arms + (kind == "ifelse"))
        return kind, more(1, True) if kind == "loop" else more(2) if kind in ("try", "case") else None

    def run(self, body, froms, loop, tries):
        """Emit a body; froms are the nodes that lead into it; the nodes that lead out of it."""
        for kind, parts in body:
            here = self.node()
            for f in froms:
                self.edge(f, here)
            for caught in tries:
                caught.append(here)
            froms = getattr(self, "do_" + kind)(here, parts, loop, tries)
        return froms

    def block(self, body, froms, loop, tries):
        """A branch: PL/SQL takes it as it is, T-SQL wants BEGIN and END unless it is one statement."""
        bare = self.plsql or (len(body) == 1 and self.random.random() < 0.6)
        self.emit(*([] if bare else ["BEGIN"]))
        out = self.run(body, froms, loop, tries)
        self.emit(*([] if bare else ["END"]))
        return out

    def end(self):
        self.emit(*([";"] if self.plsql or self.random.random() < 0.5 else []))

    def do_def(self, here, parts, loop, tries):
        self.defs[here] = f"v{here}"
        self.emit(*(["v_p", ":=", f"'v{here}'"] if self.plsql else [self.random.choice(["SET", "SELECT"]), "@p", "=", f"'v{here}'"]))
        self.end()
        return [here]

    def do_use(self, here, parts, loop, tries):
        self.uses.append(here)
        self.emit(*(["EXECUTE", "IMMEDIATE", "'BEGIN '", "||", "v_p", "||", "'(); END;'"] if self.plsql else ["EXEC", "@p"]))
        self.end()
        return [here]

    def do_other(self, here, parts, loop, tries):
        self.emit(*(["x", ":=", "CASE", "WHEN", "a", "=", "1", "THEN", "2", "ELSE", "3", "END"] if self.plsql else self.random.choice([["PRINT", "'BEGIN; END ELSE'"], ["INSERT", "INTO", "t", "(", "a", ")", "SELECT", "b", "FROM", "c"], ["UPDATE", "t", "SET", "a", "=", "CASE", "WHEN", "1", "=", "1", "THEN", "2", "ELSE", "3", "END"]])))
        self.end()
        return [here]

    def do_return(self, here, parts, loop, tries):
        self.emit("RETURN")
        self.end()
        return []

    def do_leave(self, here, parts, loop, tries):
        guarded = self.plsql and self.random.random() < 0.7
        self.emit(*(["EXIT", *(["WHEN", "a", "=", "1"] if guarded else [])] if self.plsql else ["BREAK"]))
        self.end()
        loop["out"].append(here)
        return [here] if guarded else []

    def do_again(self, here, parts, loop, tries):
        self.emit("CONTINUE")
        self.end()
        loop["again"].append(here)
        return []

    def do_if(self, here, parts, loop, tries, otherwise=False):
        outs = [] if otherwise else [here]
        self.emit("IF", "@c = 1" if not self.plsql else "a = 1", *(["THEN"] if self.plsql else []))
        for i, part in enumerate(parts):
            last = otherwise and i == len(parts) - 1
            if i:
                self.emit(*(["ELSE"] if last else ["ELSIF", "b = 2", "THEN"]))
            outs += self.block(part, [here], loop, tries)
            if not self.plsql and not last and self.words[-1] == ";" and i + 1 < len(parts):
                self.words.pop()  # no semicolon stands before ELSE
        self.emit(*(["END", "IF", ";"] if self.plsql else []))
        return outs

    def do_ifelse(self, here, parts, loop, tries):
        return self.do_if(here, parts, loop, tries, True)

    def do_loop(self, here, parts, loop, tries):
        own = {"out": [], "again": []}
        plain = self.plsql and self.random.random() < 0.4
        self.emit(*(["LOOP"] if plain else ["WHILE", "a = 1", "LOOP"] if self.plsql else ["WHILE", "@c < 3"]))
        ends = self.block(parts[0], [here], own, tries)
        self.emit(*(["END", "LOOP", ";"] if self.plsql else []))
        for e in ends + own["again"]:
            self.edge(e, here)
        return own["out"] + ([] if plain else [here])

    def do_case(self, here, parts, loop, tries):
        self.emit("CASE", "v", "WHEN", "1", "THEN")
        outs = self.run(parts[0], [here], loop, tries)
        self.emit("WHEN", "2", "THEN") if self.random.random() < 0.5 else self.emit("ELSE")
        outs += self.run(parts[1], [here], loop, tries)
        self.emit("END", "CASE", ";")
        return outs

    def do_try(self, here, parts, loop, tries):
        caught = [here]
        self.emit(*(["BEGIN"] if self.plsql else ["BEGIN", "TRY"]))
        outs = self.run(parts[0], [here], loop, [*tries, caught])
        self.emit(*(["EXCEPTION", "WHEN", "OTHERS", "THEN"] if self.plsql else ["END", "TRY", "BEGIN", "CATCH"]))
        handler = self.node()
        for c in caught:
            self.edge(c, handler)
        for t in tries:
            t.append(handler)
        outs += self.run(parts[1], [handler], loop, tries)
        self.emit(*(["END", ";"] if self.plsql else ["END", "CATCH"]))
        return outs

    def reached(self):
        """For every use that the start leads to: the values of the assignments that a walk finds, and whether the start is one."""
        out = {u: set() for u in self.uses}
        for d in [self.start, *self.defs]:
            if d != self.start and d not in self.walk(self.start, stop=False):
                continue
            for n in self.walk(d, stop=True):
                if n in out:
                    out[n].add(self.defs.get(d, ""))
        return out

    def walk(self, d, stop):
        seen, todo = set(), list(self.edges[d])
        while todo:
            n = todo.pop()
            if n not in seen:
                seen.add(n)
                todo += [] if stop and n in self.defs else self.edges[n]
        return seen


@pytest.mark.parametrize("is_plsql", [False, True])
def test_assignments_reach_uses_as_a_walk_finds_them(spark, is_plsql):
    programs = {str(seed): Program(seed, is_plsql) for seed in range(150)}
    df = spark.createDataFrame([(k, p.text()) for k, p in programs.items()], "k string, raw_sql string").repartition(4)
    dialect = ec.PLSQL if is_plsql else ec.TSQL
    found = ec.statement_table(df, "k", dialect=dialect)
    runs = ec.executions(found, "k")
    uses = runs.select("k", "line", "at", F.lit("v_p" if is_plsql else "@p").alias("variable"))
    rows = ec.trace_all(uses, ec.assignments(df, "k", dialect=dialect, found=found), found, "k").collect()
    got = {}
    for r in rows:
        held = got.setdefault(r["k"], {}).setdefault(r["at"], set())
        held |= ({r["value"].strip("'")} if r["value"] else set()) | ({""} if r["from_start"] else set())
    some = 0
    for k, p in programs.items():
        want = [v for _, v in sorted(p.reached().items())]
        mine = [v for _, v in sorted(got.get(k, {}).items())]
        assert mine == want, p.text()
        some += sum(len(v) > 1 for v in want)
    assert some > 40


LAYOUT = """CREATE PROCEDURE dbo.p @Id INT
AS
BEGIN
    DECLARE @proc VARCHAR(50);
    SET @proc = 'usp_0';
    IF @Id = 1
    BEGIN
        SET @proc = 'usp_A'
    END
    ELSE
    BEGIN
        SET @proc = 'usp_B'
    END
    EXEC @proc;
    EXEC dbo.usp_Q;
    RETURN;
END"""


def test_every_layout_gives_the_same_blocks_and_calls(spark):
    layouts = [LAYOUT, LAYOUT.replace("    ", "\t"), LAYOUT.replace("\n", "\r\n"), LAYOUT.replace("AS\nBEGIN\n", "AS BEGIN\n"), LAYOUT.replace("AS\nBEGIN\n", "  as begin\r\n")]
    df = spark.createDataFrame(list(enumerate(layouts)), "k int, raw_sql string")
    kinds = {}
    for r in extract.logical_blocks(df, "k").orderBy("k", "block").collect():
        kinds.setdefault(r["k"], []).append(r["block_type"])
    assert len(kinds) == 5 and all(v == kinds[0] for v in kinds.values())
    assert kinds[0] == ["DECLARATION", "OTHER", "IF_ELSE", "OTHER", "PROCEDURE_CALL", "PROCEDURE_CALL", "RETURN_BLOCK"] or "IF_ELSE" in kinds[0]
    calls = ec.variable_calls(df, "k").collect()
    assert [(r["certainty"], r["resolved_targets"]) for r in calls] == [("conditional", ["usp_A", "usp_B"])] * 5
    trees = {}
    for r in structure.block_tree(df, "k").orderBy("k", "node").collect():
        trees.setdefault(r["k"], []).append((r["parent"], r["arm"], r["depth"], r["block_type"]))
    assert all(t == trees[0] for t in trees.values())
    assert [t[3] for t in trees[0]] == ["BEGIN_END", "DECLARATION", "OTHER", "IF_ELSE", "BEGIN_END", "OTHER", "BEGIN_END", "OTHER", "PROCEDURE_CALL", "PROCEDURE_CALL", "RETURN_BLOCK"]
    assert [t[1] for t in trees[0]][4:8] == [0, 0, 1, 0]


def test_oracle_blocks_with_tabs_and_dispatch_in_long_branches(spark):
    unit = "PROCEDURE p IS\nBEGIN\n\tIF a > 0 THEN\n\t\tx := 1;\n\t\tv_proc := 'pkg.a';\n\tELSE\n\t\tx := 2;\n\t\tv_proc := 'pkg.b';\n\tEND IF;\n\tEXECUTE IMMEDIATE 'BEGIN ' || v_proc || '(); END;';\nEND;"
    df = spark.createDataFrame([(0, unit), (1, unit.replace("\n", "\r\n"))], "k int, raw_sql string")
    got = ec.dispatches(df, "k").collect()
    assert [(r["certainty"], r["resolved_targets"]) for r in got] == [("conditional", ["pkg.a", "pkg.b"])] * 2
    assert [r["block_type"] for r in plsql.blocks(df, ["k"]).filter("k = 1").orderBy("block").collect()] == ["IF_ELSE", "DYNAMIC_SQL"]
    loops = "PROCEDURE p IS BEGIN FOR r IN (SELECT 1 FROM dual) LOOP NULL; END LOOP; BEGIN NULL; END; MERGE INTO t USING s ON (t.a = s.a) WHEN MATCHED THEN UPDATE SET b = 1; END;"
    tree = structure.block_tree(spark.createDataFrame([(0, loops)], "k int, raw_sql string"), "k", syntax=structure.PLSQL).orderBy("node").collect()
    assert [(r["block_type"], r["depth"]) for r in tree] == [("BEGIN_END", 0), ("CURSOR_LOOP", 1), ("OTHER", 2), ("BEGIN_END", 1), ("OTHER", 2), ("DML_OPERATION", 1)]


def test_comments_and_literals_are_no_code(spark):
    text = "/* EXEC(@sql) and FROM Srv.Db.dbo.T */\n-- EXEC @proc\nPRINT 'EXEC(@x)'\nSELECT 1 FROM Srv..dbo.T3\nSELECT 1 FROM [Srv 1].Db.dbo.T2\nSELECT 1 FROM Srv.Db..T4"
    df = spark.createDataFrame([(0, text)], "k int, raw_sql string")
    assert ec.dynamic_sql(df, "k").count() == 0 and ec.variable_calls(df, "k").count() == 0
    got = sorted((r["line"], r["server"], r["database"], r["remote_object"]) for r in ec.linked_servers(df, "k").collect())
    assert got == [(4, "Srv", "", "dbo.T3"), (5, "Srv 1", "Db", "dbo.T2"), (6, "Srv", "Db", "T4")]


def test_code_keeps_lines_and_gives_literals_back(spark):
    text = "a -- it's\r\nSET @x = N'it''s -- no\nend' + [b'c] /* x\n y */ z 'open"
    df = spark.createDataFrame([(text,)], "t string").select(coded(F.col("t")).alias("c"))
    r = df.select("c.code", restored(F.col("c.code"), F.col("c.pieces")).alias("back")).first()
    assert r["code"].count("\n") == text.count("\n") and "it" not in r["code"] and "[b'c]" in r["code"]
    assert "N'it''s -- no\nend'" in r["back"] and r["back"].endswith("'open")


def test_lists_and_brackets_of_any_depth(spark):
    deep = "(" * 40 + "x,y" + ")" * 40
    df = spark.createDataFrame([(f"a, b IN (1, 2, (3, 4)), c DECIMAL(9, 2), {deep}",)], "t string")
    assert df.select(items_of(F.col("t"))).first()[0] == ["a", " b IN (1, 2, (3, 4))", " c DECIMAL(9, 2)", f" {deep}"]
    df = spark.createDataFrame([("a (b (c)) d) e )", ), ("no close (a)",)], "t string")
    assert [r[0] for r in df.select(up_to_close(F.col("t"))).collect()] == ["a (b (c)) d", "no close (a)"]


def test_empty_and_odd_sources(spark):
    df = spark.createDataFrame([(0, ""), (1, None), (2, "END END ELSE IF"), (3, "BEGIN IF @a = 1"), (4, "CREATE PROC p"), (5, ")))) SET @a = 'x' EXEC @a (((")], "k int, raw_sql string")
    assert structure.block_tree(df, "k").filter("k < 2").count() == 0
    assert ec.variable_calls(df, "k").count() <= 1
    none = df.filter("k > 9")
    assert structure.block_tree(none, "k").count() == 0 and ec.variable_calls(none, "k").count() == 0


def test_tables_with_checks_comments_and_quoted_names(spark):
    from procweave.operators import catalog

    text = """CREATE TABLE dbo.[Order Lines] ( -- note, with comma (x
    Id INT IDENTITY(1,1) NOT NULL, /* another ( */
    [Unit Price] DECIMAL(9, 2) DEFAULT ((0)),
    Status VARCHAR(10) CHECK (Status IN ('a', 'b', 'c,', 'd)', 'e', 'f')) NULL,
    OrderId INT, Part INT,
    CONSTRAINT PK_x PRIMARY KEY CLUSTERED (Id, [Unit Price] DESC),
    CONSTRAINT FK_x FOREIGN KEY (OrderId, Part) REFERENCES [sales].[Big Orders] (Id, Part),
    CHECK (Id > (1 + (2 * (3))))
);
create table Plain (a int primary key, b nvarchar(20) not null)"""
    df = spark.createDataFrame([(1, text)], "k int, t string")
    made = catalog.tables(df, ["k"], "t")
    keys = ["k", "table_name"]
    assert sorted((r["schema_name"], r["table_name"]) for r in made.collect()) == [("dbo", "Order Lines"), ("dbo", "Plain")]
    columns = catalog.columns(made, keys).orderBy("table_name", "place").collect()
    assert [(r["column_name"], r["sql_type"], r["nullable"]) for r in columns] == [
        ("Id", "INT", False), ("Unit Price", "DECIMAL(9, 2)", True), ("Status", "VARCHAR(10)", True), ("OrderId", "INT", True), ("Part", "INT", True), ("a", "int", False), ("b", "nvarchar(20)", False)
    ]
    primary = sorted((r["table_name"], r["key_place"], r["column_name"]) for r in catalog.primary_keys(made, keys).collect())
    assert primary == [("Order Lines", 0, "Id"), ("Order Lines", 1, "Unit Price"), ("Plain", 0, "a")]
    foreign = sorted((r["column_name"], r["referenced_table"], r["referenced_column"]) for r in catalog.foreign_keys(made, keys).collect())
    assert foreign == [("OrderId", "Big Orders", "Id"), ("Part", "Big Orders", "Part")]


def test_straight_code_takes_the_last_assignment(spark, monkeypatch):
    """Procedures without branches, with blocks, RETURN before or after uses and stray ENDs: as the folds find it, and without them."""
    rng = random.Random(11)
    some = ["SET @a = 'x'", "SET @b = 'y'", "EXEC @a", "EXEC @b", "PRINT 'z'", "BEGIN", "END"]
    made = ["CREATE PROCEDURE p AS BEGIN " + "; ".join(rng.choice(some) for _ in range(rng.randint(1, 14))) + rng.choice(["; RETURN", "; RETURN; EXEC @a", ""]) + " END" for _ in range(120)]
    rows = spark.createDataFrame(list(enumerate(made)), "k int, raw_sql string")
    found = ec.statement_table(rows, "k")
    assigned = ec.assignments(rows, "k", found=found).select("k", "variable", "at")
    used = ec.executions(found, "k").filter("variable is not null").select("k", "variable", "at")
    told = lambda: sorted(structure.reaching(found, assigned, used, "k").collect())
    # Uses that are no statements' are found by neither.
    odd = used.unionByName(used.withColumn("at", F.lit(-7)))
    short = told()
    assert short and sorted(structure.reaching(found, assigned, odd, "k").collect()) == short
    monkeypatch.setattr(structure, "straight", lambda events, uses: F.lit(False))
    assert told() == short
    # Without a RETURN no text needs the folds.
    monkeypatch.undo()
    plain = found.filter("word <> 'RETURN'")
    monkeypatch.setattr(structure, "nest", lambda events: F.raise_error(F.lit("folded")).cast(structure.STREAM))
    assert structure.reaching(plain, assigned, used, "k").count() >= len(short)
