from __future__ import annotations

import json

from tessera.plans import cli


def test_sheet_is_answered(spark, tmp_path):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("--- Document Chunk 1 ---\nthe password is marzipan\n--- Document Chunk 2 ---\ntrains run on rails\n")
    (tmp_path / "q.md").write_text("## Facts（2 道）\n1. what is the password?\n2. where do trains run?\n")
    store = f"file://{tmp_path}/store"
    common = ["--db-location", store, "--md-file", f"file://{tmp_path}/q.md", "--dimensions", "128"]
    for n, docs in enumerate((f"file://{tmp_path}/docs", "NONE")):
        cli.main(["--docs-dir", docs, *common, "--output", f"file://{tmp_path}/out{n}"], spark)
        lines = "".join(p.read_text() for p in sorted((tmp_path / f"out{n}").glob("part-*"))).strip().split("\n\n")
        answers = [json.loads(x)["answer"] for x in lines]
        assert answers == ["the password is marzipan", "trains run on rails"]


def test_defaults():
    a = cli.parser().parse_args(["--docs-dir", "x"])
    assert (a.load_method, a.batch_size, a.chunk_size, a.overlap, a.db_location) == ("chunked", 100, 1024, 200, "memory")


def test_chat_answers_until_exit(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "a.txt").write_text("--- Document Chunk 1 ---\nthe password is marzipan\n--- Document Chunk 2 ---\ntrains run on rails\n")
    typed = iter(["what is the password?", "zzz", "  exit "])
    monkeypatch.setattr("builtins.input", lambda _: next(typed))
    common = ["--docs-dir", f"file://{tmp_path}/docs", "--db-location", f"file://{tmp_path}/store", "--dimensions", "128"]
    cli.main(common, spark)
    assert capsys.readouterr().out.split("\n")[:2] == ["the password is marzipan", "No passage was found."]
    typed = iter(["where do trains run?", "exit"])

    def loud(query, passages):
        if "password" in query:
            raise RuntimeError("no")
        return passages[0].upper()

    cli.main(["--docs-dir", "none", *common[2:]], spark, answerer=loud)
    assert capsys.readouterr().out.split("\n")[0] == "TRAINS RUN ON RAILS"
