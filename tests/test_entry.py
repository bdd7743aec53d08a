import __spark_entry__ as entry


def test_flagship_and_contract(spark):
    out = entry.entry(spark)
    assert out.columns == ["fid", "action"] and out.count() > 0
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 140


def test_llm_parts_are_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['factloom.llm'] = None\ntry:\n import __spark_entry__\nexcept ModuleNotFoundError as e:\n print(e.name)\nelse:\n print(len(__spark_entry__.queries()))"
    got = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=entry.__file__.rsplit("/", 1)[0]).stdout.split()
    assert int(got[-1]) > 130
