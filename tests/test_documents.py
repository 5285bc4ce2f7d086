"""Whole-file gazette scan (S6) feeding the signatory job; a missing document -> unknown."""

import os

from pyspark.sql import functions as F

from atoflow.operators.roles import document_roles
from atoflow.sources.documents import read_documents, with_document


def test_documents_to_roles(spark, scratch):
    texts = {"ed1.md": "Atos do dia\nRodrigo Bacellar\nGovernador em exercício\nfim",
             "ed2.md": "GOVERNADOR SERGIO CABRAL\nVICE-GOVERNADOR X"}
    for name, text in texts.items():
        with open(os.path.join(scratch, name), "w", encoding="utf-8") as fh:
            fh.write(text)
    docs = read_documents(spark, os.path.join(scratch, "*.md"))
    got = {os.path.basename(r["path"]): r["text"] for r in docs.collect()}
    assert got == texts  # one row per file, whole text (line breaks kept)

    paths = [r["path"] for r in docs.collect()]
    acts = spark.createDataFrame([(i, p) for i, p in enumerate(paths)] + [(3, "file:/nowhere/ed3.md")],
                                 "act long, path string")
    roles = document_roles(with_document(acts, docs))
    labels = {r["act"]: r["governador_edicao"] for r in roles.collect()}
    assert labels[3] == "Nao identificado"
    assert sorted(v for k, v in labels.items() if k != 3) == [
        "Rodrigo Bacellar - Governador em exercício", "Sergio Cabral - Governador"]
    assert roles.filter(F.col("governador_edicao").isNull()).count() == 0


def test_bytes_and_newlines_as_text_mode_reads_them(spark, tmp_path):
    raws = {"a": b"x\xff\xe2\x82Ay\r\nz\rw\n", "b": "é�".encode() + b"\xc3"}
    for name, raw in raws.items():
        (tmp_path / f"{name}.md").write_bytes(raw)
    got = {r["path"][-4]: r["text"] for r in read_documents(spark, f"{tmp_path}/*.md").collect()}
    for name, raw in raws.items():
        assert got[name] == raw.decode("utf-8", "ignore").replace("\r\n", "\n").replace("\r", "\n"), name
