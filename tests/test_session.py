"""The package as executors get it."""

import subprocess
import sys

from arrears.session import package


def test_workers_can_import_the_shipped_package(tmp_path):
    archive = tmp_path / "arrears.zip"
    archive.write_bytes(package())
    code = "import arrears.operators.facts as f; print(f.__file__, len(list(f._all_facts('x = 1'))))"
    # -I: neither the working directory nor PYTHONPATH is searched.
    run = subprocess.run([sys.executable, "-I", "-c", f"import sys; sys.path.insert(0, {str(archive)!r}); {code}"],
                         cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode == 0, run.stderr
    assert str(archive) in run.stdout and run.stdout.strip().endswith("2")
