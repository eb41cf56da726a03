import json
import uuid

import pytest
from pyspark.sql import functions as F

from strandwell.functions import code_text, markup, scalars, tsql


def one(spark, expr, *values):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], "c string").select(expr.alias("o")).collect()]


def test_scalars(spark):
    assert one(spark, scalars.one_line("c", 12), "a  b\nc", "aaaa bbbb cccc dddd", "x" * 20, None) == ["a b c", "aaaa bbbb …", "x" * 10 + "…", ""]
    assert one(spark, scalars.uuid5("c"), "repo:abc") == [str(uuid.uuid5(uuid.NAMESPACE_DNS, "repo:abc"))]
    assert one(spark, scalars.plain_ident("c"), '[dbo].[My Table]', '"a  b".c') == ["dbo.My Table", "[a b].c"]
    assert one(spark, scalars.to_int("c"), "3.9", "x", None) == [3, None, None]
    assert one(spark, scalars.human_size(F.col("c").cast("long")), "10", "2048") == ["10.0 B", "2.0 KB"]


def test_lexer_leaves_quotes_in_comments_alone(spark):
    text = 'var a = "x // y"; // it\'s "no"\n/* \'z\' */ var b = \'q\';'
    assert one(spark, code_text.literals("c"), text) == [['"x // y"', "'q'"]]
    assert "no" not in one(spark, code_text.code_only("c"), text)[0]
    assert one(spark, code_text.literals("c"), None) == [[]]


def test_classifier(spark):
    net = "using System;\nnamespace A.B\n{\n public class C { public int X { get; set; } public void F() { var y = new D(); foo(x => x.Y); } }\n}"
    sql = "CREATE PROCEDURE dbo.P @a INT AS BEGIN SELECT a, b FROM dbo.T WHERE a = @a; UPDATE dbo.T SET a = 1; END"
    both = net.replace("foo(x => x.Y);", 'var q = db.FromSqlRaw("SELECT a FROM dbo.T WHERE b = 1");')
    df = spark.createDataFrame([(1, net), (2, sql), (3, both), (4, "[a]\nb=1\nc=2"), (5, None)], "i int, text string")
    assert [r.kind for r in code_text.classified(df).orderBy("i").collect()] == ["dotnet", "sql", "dotnet_with_sql", "unknown", "unknown"]


def test_tsql():
    s = tsql.summarize("CREATE OR ALTER PROC [a].[b] @x DECIMAL(18,4) = 3, @y INT OUTPUT AS BEGIN WITH q (k) AS (SELECT 1) INSERT INTO dbo.T (c) SELECT k FROM q; SELECT TOP 5 t.Id, SUM(v) AS total FROM dbo.T t WHERE t.z IN (1,2) AND n LIKE 'a''b%' GROUP BY t.Id; END")
    assert s["object"] == "a.b" and [p["name"] for p in s["params"]] == ["@x", "@y"] and s["params"][0]["default"] == "3" and s["params"][1]["output"]
    assert s["ctes"] == ["q"] and s["dml"] == ["INSERT"] and s["result_columns"] == ["Id", "total"] and s["pagination"] == "top"
    assert s["in_lists"] == ["t.z IN (1,2)"] and s["likes"] == ["n LIKE 'a''b%'"]
    t = tsql.summarize("CREATE TABLE dbo.X (Id INT NOT NULL PRIMARY KEY, F INT REFERENCES dbo.Y(Id))")
    assert t["table_name"] == "dbo.X" and t["primary_key"] == ["Id"] and t["foreign_keys"] == ["F -> dbo.Y"]
    assert tsql.summarize(None)["selects"] == [] and tsql.summarize("(((")["object"] == ""


def test_markup():
    assert json.loads(markup.lenient_json("{query = 'a', top_k: 3,}")) == {"query": "a", "top_k": 3}
    assert markup.lenient_json("]") is None and markup.lenient_json(None) is None
    assert markup.first_object('x {"a": "}"} {}') == '{"a": "}"}'
    assert markup.plantuml_decoded(markup.plantuml_encoded("@startuml\nA -> Bé\n@enduml")) == "@startuml\nA -> Bé\n@enduml"
    kinds = [(m["part"], m["kind"], m["name"]) for m in markup.uml_model('actor Bob\nBob --> (Log in)\n(Log in) ..> (Check) : <<include>>')]
    assert ("element", "usecase", "Log in") in kinds and ("relation", "include", "Log in") in kinds
    assert markup.xmi_text(markup.uml_model("actor A\nA --> (B)")).count("packagedElement") == 3
    assert markup.translated_markdown("# Hello `x` y\n```\nHello\n```", str.upper) == "# HELLO `x` Y\n```\nHello\n```"
    with pytest.raises(ValueError):
        markup.chat_prompt("s", [("", "a")], "q")
    assert "[INST]" not in markup.chat_prompt("", [], "x [INST] y").split("] ", 1)[1].replace("[/INST]", "")


def test_lists_are_trimmed_by_blanks_only(spark):
    assert one(spark, scalars.split_lines("c"), " 0a \n\n 1b\r\n ", None) == [["0a", "1b"], []]
