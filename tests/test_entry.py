"""Entry module and workers without the optional parts and from another folder."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _python(code, tmp_path, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120,
                          env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | env)


def test_entry_works_without_the_optional_operators(tmp_path):
    code = (f"import sys; sys.path.insert(0, {REPO!r}); sys.modules['corpus_pipeline'] = None\n"
            "import __spark_entry__ as e\n"
            "q, s = e.queries(), e.oracle_sql()\n"
            "assert len(q) >= 100 and set(s) <= set(q) and 'pipeline' not in q")
    done = _python(code, tmp_path)
    assert done.returncode == 0, done.stderr


def test_entry_works_without_a_dependency_of_the_optional_operators(tmp_path):
    for missing in ("zstandard", "xxhash", "regex"):
        code = (f"import sys; sys.path.insert(0, {REPO!r}); sys.modules[{missing!r}] = None\n"
                "import __spark_entry__ as e\nassert len(e.queries()) >= 100")
        done = _python(code, tmp_path)
        assert done.returncode == 0, done.stderr


def test_worker_functions_are_pickled_by_value(tmp_path):
    from pyspark import cloudpickle
    from lexmesh.operators.ensemble import member_proba
    (tmp_path / "f").write_bytes(cloudpickle.dumps(member_proba))
    code = ("import sys, pickle\nsys.path = [p for p in sys.path if p not in ('', " + repr(REPO) + ")]\n"
            "f = pickle.load(open('f', 'rb'))\nassert f.__name__ == 'member_proba' and 'lexmesh' not in sys.modules")
    done = _python(code, tmp_path)
    assert done.returncode == 0, done.stderr
