import subprocess
import sys
from pathlib import Path

import pytest

ENTRY = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked} or name in {blocked}:
            raise ModuleNotFoundError(f"No module named {{name!r}}", name=name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as entry
print(len(entry.queries()), "flagship_plz_peak_transformer" in entry.queries(), any(q.startswith("op1") or q == "pipeline" for q in entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))
"""


@pytest.mark.parametrize("blocked, more", [(("public_tokenizers", "tokenizers", "sentencepiece"), None), (("gridwright.llm", "corpus_pipeline"), False)])
def test_entry_without_what_only_the_pipeline_needs(blocked, more):
    root = Path(__file__).parent.parent
    said = subprocess.run([sys.executable, "-c", ENTRY.format(blocked=blocked)], cwd=root, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-500:]
    n, flagship, ops, named = said.stdout.split()
    assert int(n) >= 180 and flagship == named == "True"
    assert more is None or ops == str(more)
