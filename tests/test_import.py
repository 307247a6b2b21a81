"""The contract modules import without a session, as the driver may read the SQL before it starts one."""

import subprocess
import sys


def test_import_without_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) >= len(e.oracle_sql()) > 150"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0
