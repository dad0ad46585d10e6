"""Registered protection queries: row filters per reader, filter-then-rank, encryption."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions.vectors import cosine_distance, rounded
from lodestar.operators import secure as se
from lodestar.operators import textops as tx
from lodestar.operators.relational import with_department
from lodestar.plans.common import chunks
from lodestar.plans.registry import register
from lodestar.plans.sqlparts import CHUNKS, CORPUS, EMAIL, cos
from lodestar.sources.tables import corpus

_UD = "ud AS (SELECT * FROM (VALUES ('hr_user', 'HR'), ('it_user', 'IT')) t(user_name, department))"
_DEPT = """CASE WHEN source IN ('src0', 'src1', 'src2', 'src3') THEN 'IT'
                WHEN source IN ('src4', 'src5', 'src6', 'src7') THEN 'Finance' ELSE 'HR' END"""


@register("rls_counts", f"""WITH {CHUNKS}, {_UD},
grants AS (SELECT user_name, department FROM ud UNION ALL SELECT 'dbo', department FROM (SELECT DISTINCT department FROM chunks))
SELECT g.user_name, c.department, count(*) AS visible_chunks FROM chunks c JOIN grants g USING (department) GROUP BY 1, 2""")
def rls_counts(spark, sf):
    return se.visible_counts(chunks(spark, sf), se.user_departments(spark))


@register("rls_knn", f"""WITH {CORPUS}, {_UD},
cd AS (SELECT *, {_DEPT} AS department FROM corpus),
q AS (SELECT embedding FROM cd WHERE department = 'IT' ORDER BY id LIMIT 1)
SELECT id, source, {cos('embedding', '(SELECT embedding FROM q)')} AS distance FROM cd
WHERE department IN (SELECT department FROM ud WHERE user_name = 'hr_user')
ORDER BY distance, id LIMIT 3""")
def rls_knn(spark, sf):
    """The HR reader's 3 nearest rows to an IT question: the filter runs before the top-k."""
    c = with_department(corpus(spark, sf))
    qvec = c.where(F.col("department") == "IT").orderBy("id").select("embedding").limit(1).scalar()
    visible = se.visible_to(c, "hr_user", se.user_departments(spark))
    return (visible.select("id", "source", "embedding", qvec.alias("_q"))
            .select("id", "source", rounded(cosine_distance("embedding", "_q")).alias("distance"))
            .orderBy("distance", "id").limit(3))


# A test key (32 bytes, AES-256); on a cluster the key comes from the caller's key store.
TEST_KEY = "0123456789abcdef0123456789abcdef"
WRONG_KEY = "fedcba9876543210fedcba9876543210"


@register("encrypt_roundtrip", f"""WITH {CHUNKS},
contacts AS (SELECT email, min(source) AS source FROM (
  SELECT nullif(regexp_extract(content, '{EMAIL}'), '') AS email, source FROM chunks) WHERE email IS NOT NULL GROUP BY email)
SELECT email, source, (strlen(email) + 28)::INTEGER AS encrypted_bytes, true AS decrypted_ok, true AS wrong_key_null FROM contacts""")
def encrypt_roundtrip(spark, sf):
    con = tx.contacts(chunks(spark, sf))
    enc = con.withColumn("enc", se.encrypt(F.col("email"), F.lit(TEST_KEY)))
    return enc.select("email", "source", F.octet_length("enc").alias("encrypted_bytes"),
                      (se.decrypt(F.col("enc"), F.lit(TEST_KEY)) == F.col("email")).alias("decrypted_ok"),
                      se.decrypt(F.col("enc"), F.lit(WRONG_KEY)).isNull().alias("wrong_key_null"))
