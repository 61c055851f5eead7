"""Every query of the subpackage that has SQL against it, the others for running over whole tables."""

import pytest

from conftest import check_against_sql
from tellstone.llm import registry


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, folder, duck, name):
    if name in registry.SQL:
        check_against_sql(spark, folder, duck, registry.QUERIES[name], registry.SQL[name])
    else:
        registry.QUERIES[name](spark, folder).count()


def test_package_is_optional():
    import subprocess
    import sys

    code = "import sys; sys.modules['tellstone.llm'] = None; import __spark_entry__ as e; assert not [q for q in e.queries() if q[0] == 'p' and q[1:2].isdigit() and q[:3] != 'p4_']; import tellstone.api"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(__import__("conftest").ROOT))
