"""The driver's contract."""

import __spark_entry__ as entry
from indexloom.plans import catalog


def test_names_agree():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(catalog.queries()) <= set(queries)
    assert set(sql) <= set(queries)
    assert catalog.FLAGSHIP in queries and len(catalog.queries()) >= 60


def test_works_without_the_optional_part(tmp_path):
    """The rest imports and registers its queries when the removable folders are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(entry.__file__).resolve().parent
    shutil.copytree(root / "indexloom", tmp_path / "indexloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    n, m, some = out.stdout.split()
    assert int(n) == len(catalog.queries()) and int(m) == len(catalog.oracle_sql()) and some == "False"


def test_works_without_what_the_optional_part_needs(tmp_path):
    """The others register when a package of the optional part is missing, with its files there."""
    import subprocess
    import sys
    from pathlib import Path

    (tmp_path / "public_tokenizers.py").write_text("raise ModuleNotFoundError(name='public_tokenizers')")
    root = Path(entry.__file__).resolve().parent
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": f"{tmp_path}:{root}"})
    assert tuple(map(int, out.stdout.split())) == (len(catalog.queries()), len(catalog.oracle_sql()))
