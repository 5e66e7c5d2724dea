"""Compare this subpackage's queries that have SQL with DuckDB: ``python tests/llm/oracle_llm.py 0.001 [name ...]``."""

import sys

sys.path.insert(0, __file__.rsplit("/", 3)[0])

from strandframe.llm.queries import CORPUS
from strandframe.session import local_session
from tests.oracle import compare, connect

if __name__ == "__main__":
    sf = "/root/testdata/sf" + sys.argv[1]
    spark, con = local_session(8), connect(sf)
    for name, q in CORPUS.items():
        if q.sql is not None and (not sys.argv[2:] or name in sys.argv[2:]):
            print(name, *compare(spark, con, q, sf), flush=True)
