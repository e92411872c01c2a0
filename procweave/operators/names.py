"""Which tables statements name: names, aliases and common table expressions, each in the scope that declares it.

A statement's tokens carry the depth of brackets around them, so a scope is the stretch of tokens at one depth or deeper.
The items of FROM lists, joins and targets are found by the word before them; a name without a schema is a common table
expression where one of that name was declared before it in the same statement and its scope still holds; the target of an
UPDATE or DELETE that another item has as its alias stands for that item. Quoted names may hold any characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from procweave.operators.code import let
from procweave.operators.structure import TSQL, Syntax, statements

#: Words that begin a clause: a comma after them is no longer one of a FROM list.
CLAUSES = "SELECT FROM WHERE GROUP ORDER HAVING UNION EXCEPT INTERSECT MINUS SET VALUES OPTION OUTPUT RETURNING CONNECT START".split()

#: Words before a table, and words that are none themselves.
BEFORE = "FROM JOIN APPLY USING INTO UPDATE MERGE DELETE INSERT".split()
NO_NAME = (
    "SELECT SET VALUES WHERE TOP INTO FROM STATISTICS DUAL TABLE LATERAL ONLY EXEC EXECUTE DEFAULT WITH AS ON WHEN OUTPUT USING OPENROWSET OPENQUERY OPENJSON OPENXML OPENDATASOURCE ALL OF NOWAIT SKIP IF"
).split()

#: Words after a table that are not its alias.
NO_ALIAS = CLAUSES + "ON INNER LEFT RIGHT FULL CROSS OUTER JOIN NATURAL WHEN USING WITH FOR INTO UPDATE DELETE INSERT MERGE TABLESAMPLE PIVOT UNPIVOT LOOP AS END BEGIN".split()

#: Lock hints that may stand in brackets after a table.
HINTS = "NOLOCK READPAST UPDLOCK HOLDLOCK ROWLOCK TABLOCK TABLOCKX XLOCK PAGLOCK READUNCOMMITTED READCOMMITTED SERIALIZABLE REPEATABLEREAD NOWAIT INDEX".split()

#: Pseudo tables of triggers and OUTPUT.
PSEUDO = ("INSERTED", "DELETED")

NAME = r'^(?:\[.+\]|".+"|[#A-Z_]\S*)$'


def named_tables(toks: Column, syntax: Syntax = TSQL) -> Column:
    """The tables of one statement's tokens, in order: structs (at, name), as they are written but for quotes."""
    w = lambda i: F.get(toks, i)["word"]
    deep = lambda i: F.get(toks, i)["paren"]
    first = w(F.lit(0))
    places = lambda condition: F.filter(F.transform(toks, lambda t, i: F.when(condition(t, i), i)), lambda i: i.isNotNull())
    bare = lambda i: F.regexp_replace(F.regexp_replace(F.get(toks, i)["raw"], r"\s+$", ""), r'^[\["]|[\]"]$', "")

    def within(clauses: Column) -> Column:
        def clause_before(i: Column) -> Column:
            """The last clause word of the same bracket before a place: none where a bracket closed in between."""
            own = F.filter(clauses, lambda q: (q < i) & (deep(q) == deep(i)))
            last = F.array_max(own)
            closed = F.exists(F.slice(toks, last + 1, F.greatest(i - last, F.lit(1))), lambda t: t["paren"] < deep(i))
            return F.when(last.isNotNull() & ~closed, w(last))

        def starts(i: Column, word: Column) -> Column:
            prev = w(i - 1)
            of_query = clause_before(i - 1).isin("SELECT", "SET", "VALUES", "OUTPUT", "FROM") | first.isin("DELETE", "UPDATE", "MERGE")
            direct = prev.isin(*BEFORE) & ((prev != "FROM") | (of_query & (F.coalesce(w(i - 2), F.lit("")) != "DISTINCT"))) & ((prev != "USING") | (first == "MERGE")) & ((prev != "UPDATE") | (F.coalesce(w(i - 2), F.lit("")) != "FOR"))
            if syntax is not TSQL:
                # What SELECT, FETCH and RETURNING put into are variables.
                direct = direct & ((prev != "INTO") | first.isin("INSERT", "MERGE") | w(i - 2).isin("INSERT", "MERGE"))
            listed = (prev == ",") & (clause_before(i) == "FROM")
            return (direct | listed) & F.rlike(word, F.lit(NAME)) & ~word.isin(*NO_NAME)

        def item(i: Column) -> Column:
            dot = lambda e: w(e + 1).isin(".", "..")
            last = F.when(dot(i), F.when(dot(i + 2), F.when(dot(i + 4), i + 6).otherwise(i + 4)).otherwise(i + 2)).otherwise(i)
            parts = 1 + F.size(F.filter(F.slice(toks, i + 1, last - i + 1), lambda t: t["word"] == ".")) + 2 * F.size(F.filter(F.slice(toks, i + 1, last - i + 1), lambda t: t["word"] == ".."))
            alias_at = F.when(w(last + 1) == "AS", last + 2).otherwise(last + 1)
            alias = F.when(F.rlike(w(alias_at), F.lit(NAME)) & ~w(alias_at).isin(*NO_ALIAS), F.lower(bare(alias_at)))
            # A name with brackets after it is a function, unless they hold columns to insert or hints.
            function = (w(last + 1) == "(") & ~w(i - 1).isin("INTO", "INSERT") & ~F.coalesce(w(last + 2).isin(*HINTS), F.lit(False))
            return F.struct(i.alias("i"), F.get(toks, i)["at"].alias("at"), w(i - 1).alias("prev"), bare(last).alias("name"), parts.alias("parts"), alias.alias("alias"), F.coalesce(function, F.lit(False)).alias("function"))

        found = places(lambda t, i: starts(i, t["word"]))
        return F.struct(F.transform(found, item).alias("items"), common_tables().alias("common"))

    def common_tables() -> Column:
        """The common table expressions: structs (i, name, stop), visible after i and before stop."""
        column_list = lambda i: F.get(F.filter(F.transform(toks, lambda t, j: F.when((j > i + 1) & (t["word"] == ")") & (t["paren"] == deep(i + 1)), j)), lambda j: j.isNotNull()), 0)
        declares = lambda i: ((w(i + 1) == "AS") & (w(i + 2) == "(")) | ((w(i + 1) == "(") & (w(column_list(i) + 1) == "AS") & (w(column_list(i) + 2) == "("))
        begun = lambda i: (w(i - 1) == "WITH") | ((w(i - 1) == ",") & (w(i - 2) == ")"))
        own = places(lambda t, i: F.rlike(t["word"], F.lit(NAME)) & begun(i) & F.coalesce(declares(i), F.lit(False)))
        stop = lambda i: F.coalesce(F.get(F.filter(F.transform(toks, lambda t, j: F.when((j > i) & (t["paren"] < deep(i)), j)), lambda j: j.isNotNull()), 0), F.size(toks))
        return F.transform(own, lambda i: F.struct(i.alias("i"), F.lower(bare(i)).alias("name"), stop(i).alias("stop")))

    def resolved(s: Column) -> Column:
        hidden = lambda t: (t["parts"] == 1) & F.exists(s["common"], lambda c: (c["name"] == F.lower(t["name"])) & (c["i"] < t["i"]) & (t["i"] < c["stop"]))
        target = lambda t: t["prev"].isin("UPDATE", "DELETE", "FROM") & (t["parts"] == 1) & F.exists(s["items"], lambda o: (o["i"] != t["i"]) & F.coalesce(o["alias"] == F.lower(t["name"]), F.lit(False)))
        none = lambda t: t["name"].startswith("#") | t["name"].contains("@") | F.upper(t["name"]).isin(*PSEUDO) & (t["parts"] == 1)
        kept = F.filter(s["items"], lambda t: (t["parts"] < 4) & ~t["function"] & ~hidden(t) & ~target(t) & ~none(t))
        return F.transform(kept, lambda t: F.struct(t["at"].alias("at"), t["name"].alias("name")))

    own = let(let(places(lambda t, i: t["word"].isin(*CLAUSES)), within), resolved)
    none = F.array().cast("array<struct<at: int, name: string>>")
    return F.when(~first.isin("FETCH", "OPEN", "CLOSE") & F.exists(toks, lambda t: t["word"].isin(*BEFORE)), own).otherwise(none)


def table_references(procedures: DataFrame, key: str, text: str = "raw_sql", syntax: Syntax = TSQL) -> DataFrame:
    """Every table that the statements of a body name: key, at (its first place), line and table_name, each once a procedure."""
    found = statements(procedures, key, text, syntax).select(key, F.col("line").alias("s_line"), F.explode(named_tables(F.col("toks"), syntax)).alias("t"))
    return found.groupBy(key, F.col("t.name").alias("table_name")).agg(F.min("t.at").alias("at"), F.min("s_line").alias("line"))
