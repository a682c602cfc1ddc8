"""The registered queries of the language-model operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..tables import load
from . import abuse, doc_pairs, machine_files, mixture, packing, similar_vectors, tokens

#: The owner of the files in question, whose notices do not make them a third party's.
IN_HOUSE = ("hollowpine systems",)

QUERIES = {
    "p4_found": lambda s, d: machine_files.machine_files(load(s, d, "files"), IN_HOUSE).select("repo_id", "path"),
    "p4_reasons": lambda s, d: machine_files.machine_files(load(s, d, "files"), IN_HOUSE).select("repo_id", "path", F.array_join("reasons", ",").alias("reasons")),
    "p5_found": lambda s, d: doc_pairs.documented_functions(load(s, d, "files")).select("repo_id", "path", "name", "start_line").distinct(),
    "p5_pairs": lambda s, d: doc_pairs.documented_functions(load(s, d, "files")),
}


def _scores(spark, d):
    documents = load(spark, d, "documents")
    return abuse.score_documents(documents, abuse.train(documents, load(spark, d, "review_labels")))


QUERIES |= {
    "p8_found": lambda s, d: _scores(s, d).where("abusive").select("doc_id"),
    "p8_scores": lambda s, d: _scores(s, d).select("doc_id", "source", "score", "abusive"),
    "p8_rates": lambda s, d: abuse.source_rates(_scores(s, d)),
}


def _sizes(spark, d):
    return tokens.document_sizes(load(spark, d, "documents"))


QUERIES |= {
    "p2_found": lambda s, d: similar_vectors.mutual_pairs(load(s, d, "vectors")),
    "p2_neighbours": lambda s, d: similar_vectors.neighbours(load(s, d, "vectors")),
    "p6_packing": lambda s, d: packing.pack(_sizes(s, d), load(s, d, "pack_sizes")),
    "p6_fill": lambda s, d: packing.fill_report(packing.pack(_sizes(s, d), load(s, d, "pack_sizes")), load(s, d, "pack_sizes")),
    "p7_mixture": lambda s, d: mixture.mixture(_sizes(s, d), load(s, d, "mix_targets")),
    "p7_shares": lambda s, d: mixture.shares(_sizes(s, d), load(s, d, "mix_targets")),
    "p7_feasible_shares": lambda s, d: mixture.shares(_sizes(s, d), load(s, d, "mix_targets"), mixture.FEASIBLE),
}

_ID = r"trim(regexp_replace(chunk_id, '[\t-\r\x1c-\x20\x{85}\p{Z}]+', ' ', 'g'))"
#: Every usable vector against every other of its model: what the search by codes must come to.
SQL = {
    "p2_found": f"""with v as (select model, dim, {_ID} as id, min(vector) as vector from vectors
      where model is not null and chunk_id is not null and vector is not null and len(vector) = dim and dim > 0 and len(list_filter(vector, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(vector, lambda x: x <> 0)) > 0 group by 1, 2, 3),
    near as (select *, row_number() over (partition by model, dim, a order by s desc, b) as n from (
      select p.model, p.dim, p.id as a, q.id as b, round(list_cosine_similarity(p.vector::double[], q.vector::double[]), 9) as s from v p join v q on q.model = p.model and q.dim = p.dim and q.id <> p.id))
    select distinct x.a as chunk_id_a, x.b as chunk_id_b from near x join near y on y.model = x.model and y.dim = x.dim and y.a = x.b and y.b = x.a where x.a < x.b and x.n <= 10 and y.n <= 10 and x.s >= 0.9""",
}
