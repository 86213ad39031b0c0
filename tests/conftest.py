import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from codestrata.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, 4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture
def facts(spark):
    """``facts({path: source})`` -> (syntax rows, methods, classes, project), each written once."""
    from codestrata.operators import classfacts
    from codestrata.session import cut_lineage
    from codestrata.sources.python_syntax import syntax_rows

    def make(files):
        given = spark.createDataFrame(list(files.items()), "path string, source string")
        rows = cut_lineage(syntax_rows(given))
        methods = cut_lineage(classfacts.method_facts(rows))
        classes = cut_lineage(classfacts.class_facts(rows, methods))
        return rows, methods, classes, cut_lineage(classfacts.project_classes(classes))

    return make
