from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]


def test_entry(spark):
    rows = entry.entry(spark).collect()
    assert rows and all(r.lower <= r.delay_rate <= r.upper for r in rows)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_corpus_part(tmp_path):
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('skyledger.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'pipeline' not in names and not any(n.startswith('op1_') for n in names) and len(names) > 50\n"
        "e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_errors_in_the_corpus_part_are_not_hidden():
    code = (
        "import sys\n"
        "sys.modules['xxhash'] = None\n"
        "try:\n"
        "    import __spark_entry__\n"
        "except ImportError as e:\n"
        "    print('raised', e)\n"
    )
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120, capture_output=True, text=True).stdout
    assert ("raised" in out) == (ROOT / "skyledger" / "llm").exists()
