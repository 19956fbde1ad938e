"""The entry must import without a session, and without the text subpackage."""

import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent.parent)


def _run(before: str) -> int:
    code = f"import sys; sys.path.insert(0, {ROOT!r}); {before}; import __spark_entry__ as e; print('N', len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    return int(out.stdout.split("N ")[1])


def test_entry_imports_without_a_session_and_without_the_text_subpackage():
    alone = _run("sys.modules['lamina.llm'] = None")
    assert 100 < alone <= _run("pass")
