"""Generators and chain metrics as table functions (X06), callable from SQL, with LATERAL and with PARTITION BY.

    register(spark)
    SELECT l.organism, s.* FROM lengths l, LATERAL steric_chain(l.chain_id, l.length) s
    SELECT * FROM chain_metrics(TABLE(residues) PARTITION BY chain_id ORDER BY pos)

Each call holds one chain. Generators are seeded by the chain's id, so a call gives what the DataFrame operators give.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

METRICS = "chain_id bigint, length bigint, bps double, bps_norm double, mean_dw double, torus_l1 double, torus_l2 double, q_phi double, q_psi double, n_transitions bigint"


def _generator(chain_id):
    import numpy as np

    from angleweave.operators.generators import chain_seed

    return np.random.default_rng(chain_seed(chain_id))


@udtf(returnType="pos int, phi double, psi double")
class StericChain:
    """steric_chain(chain_id, length): M12's second model. No rows for a null or a length below 1."""

    def eval(self, chain_id: int, length: int):
        from angleweave.operators.generators import steric_walk

        if chain_id is not None and length is not None and length > 0:
            for k, (phi, psi) in enumerate(steric_walk(length, _generator(chain_id))[0].tolist(), 1):
                yield k, phi, psi


@udtf(returnType="pos int, attempts int, rejected int")
class StericAttempts:
    """steric_attempts(chain_id, length): the proposals of every residue after the first."""

    def eval(self, chain_id: int, length: int):
        from angleweave.operators.generators import steric_walk

        if chain_id is not None and length is not None and length > 0:
            for k, (attempts, rejected) in enumerate(steric_walk(length, _generator(chain_id))[1], 2):
                yield k, attempts, rejected


@udtf(returnType="pos int, phi double, psi double")
class ProteinLike:
    """protein_like(chain_id): M13; the first phi and the last psi are null."""

    def eval(self, chain_id: int):
        from angleweave.operators.generators import protein_like_walk

        if chain_id is not None:
            rows = protein_like_walk(_generator(chain_id)).tolist()
            for k, (phi, psi) in enumerate(rows, 1):
                yield k, None if phi != phi else phi, None if psi != psi else psi


@udtf(returnType=METRICS)
class ChainMetrics:
    """chain_metrics(TABLE(t) PARTITION BY chain_id ORDER BY pos): N01-N05 and N07 of each chain. t: chain_id, pos, phi, psi, w, basin."""

    def __init__(self):
        self.rows, self.chain = [], None

    def eval(self, row):
        self.chain = row["chain_id"]
        self.rows.append((row["pos"], 0, row["phi"], row["psi"], row["w"], row["basin"]))

    def terminate(self):
        import pandas as pd

        from angleweave.streaming.chain_metrics import metrics

        if self.rows:
            found = metrics(pd.DataFrame(self.rows, columns=["at", "tie", "phi", "psi", "w", "basin"]))
            yield self.chain, *found.values()


def register(spark: SparkSession) -> None:
    for name, function in (("steric_chain", StericChain), ("steric_attempts", StericAttempts), ("protein_like", ProteinLike), ("chain_metrics", ChainMetrics)):
        spark.udtf.register(name, function)
