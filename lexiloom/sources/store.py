"""Sessions and their accepted patches: append-only Parquet tables, or a database through Spark's JDBC source."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom import schemas
from lexiloom.operators.config import Prescription

#: The tables of a database, in types that all databases have.
TABLES = {
    "lexiloom_session": "session_id VARCHAR(64) NOT NULL, target_query VARCHAR(2000), created_at TIMESTAMP NOT NULL",
    "lexiloom_patch": "session_id VARCHAR(64) NOT NULL, seq INTEGER NOT NULL, prescription VARCHAR(30000) NOT NULL, evidence VARCHAR(30000) NOT NULL, attempts INTEGER NOT NULL, created_at TIMESTAMP NOT NULL, PRIMARY KEY (session_id, seq)",
    "lexiloom_baseline": "name VARCHAR(200) NOT NULL, saved_at TIMESTAMP NOT NULL, query VARCHAR(2000) NOT NULL, ndcg DOUBLE PRECISION, recall DOUBLE PRECISION, precision5 DOUBLE PRECISION, n_results BIGINT",
}


@dataclass(frozen=True)
class PatchStore:
    """Sequence numbers are the greatest so far plus one: in files for one writer a session. With `jdbc`, tables live in
    that database, migrate() makes them, and its keys keep two writers from giving one number twice."""

    spark: SparkSession
    root: str
    jdbc: str | None = None

    def migrate(self) -> list[str]:
        """Makes the tables that the database lacks, with their keys, and names them; tables that are there stay as they are."""
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.jdbc)
        try:
            there, names = connection.getMetaData().getTables(None, None, "%", None), set()
            while there.next():
                names.add(there.getString("TABLE_NAME").lower())
            made = [t for t in TABLES if t not in names]
            for t in made:
                connection.createStatement().execute(f"CREATE TABLE {t} ({TABLES[t]})")
            return made
        finally:
            connection.close()

    def _insert_patch(self, session_id: str, values: tuple, tries: int = 5) -> int:
        """One row with the session's next number; where another writer took that number, the next one."""
        connection = self.spark._jvm.java.sql.DriverManager.getConnection(self.jdbc)
        try:
            for left in range(tries, 0, -1):
                ask = connection.prepareStatement("SELECT COALESCE(MAX(seq), 0) + 1 FROM lexiloom_patch WHERE session_id = ?")
                ask.setString(1, session_id)
                rows = ask.executeQuery()
                rows.next()
                seq = rows.getInt(1)
                put = connection.prepareStatement("INSERT INTO lexiloom_patch (session_id, seq, prescription, evidence, attempts, created_at) VALUES (?, ?, ?, ?, ?, CURRENT_TIMESTAMP)")
                put.setString(1, session_id)
                put.setInt(2, seq)
                put.setString(3, values[0])
                put.setString(4, values[1])
                put.setInt(5, values[2])
                try:
                    put.executeUpdate()
                    return seq
                except Py4JJavaError as e:
                    # Class 23: a constraint, here the key.
                    if left == 1 or not str(e.java_exception.getSQLState()).startswith("23"):
                        raise
        finally:
            connection.close()

    def _table(self, name: str, schema: str) -> DataFrame:
        if self.jdbc:
            return self.spark.read.jdbc(self.jdbc, f"lexiloom_{name}")
        try:
            return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], schema)

    def _append(self, name: str, row: tuple, schema: str) -> None:
        df = self.spark.createDataFrame([row], schema)
        if self.jdbc:
            df.write.jdbc(self.jdbc, f"lexiloom_{name}", mode="append")
        else:
            df.coalesce(1).write.mode("append").parquet(f"{self.root}/{name}")

    def create_session(self, session_id: str, target_query: str) -> None:
        self._append("session", (session_id, target_query, datetime.now(timezone.utc)), schemas.SESSION)

    def delete_session(self, session_id: str) -> None:
        """Deletion is a row too: a session whose last row has no target is gone."""
        self._append("session", (session_id, None, datetime.now(timezone.utc)), schemas.SESSION)

    def sessions(self) -> DataFrame:
        """session_id, target_query, n_patches of sessions that exist."""
        last = self._table("session", schemas.SESSION).groupBy("session_id").agg(F.max_by("target_query", "created_at").alias("target_query"), F.max("created_at").alias("created_at")).where("target_query is not null")
        patches = self._table("patch", schemas.STORED_PATCH).groupBy("session_id").agg(F.count("seq").alias("n"))
        return last.join(patches, "session_id", "left").select("session_id", "target_query", F.coalesce("n", F.lit(0)).alias("n_patches"))

    def append_patch(self, session_id: str, patch: Prescription, verdict, attempts: int) -> int:
        """Stores an accepted patch; rejected ones are never stored."""
        if not verdict.accepted:
            raise ValueError("a rejected patch isn't stored")
        if self.jdbc:
            return self._insert_patch(session_id, (patch.to_json(), json.dumps(asdict(verdict), ensure_ascii=False), attempts))
        seq = self._table("patch", schemas.STORED_PATCH).where(F.col("session_id") == session_id).agg(F.coalesce(F.max("seq"), F.lit(0)) + 1).first()[0]
        self._append("patch", (session_id, seq, patch.to_json(), json.dumps(asdict(verdict), ensure_ascii=False), attempts, datetime.now(timezone.utc)), schemas.STORED_PATCH)
        return seq

    def patches(self, session_id: str) -> list[Prescription]:
        """In their order, to be replayed without another gate."""
        rows = self._table("patch", schemas.STORED_PATCH).where(F.col("session_id") == session_id).orderBy("seq").select("prescription").collect()
        return [Prescription.from_json(r[0]) for r in rows]

    def save_baseline(self, name: str, measured: DataFrame) -> None:
        """Replaces the baseline of that name; in a database its rows are appended as a new version, the last of which counts."""
        rows = measured.select("query", "ndcg", "recall", "precision5", "n_results")
        if self.jdbc:
            rows.select(F.lit(name).alias("name"), F.lit(datetime.now(timezone.utc)).alias("saved_at"), "*").write.jdbc(self.jdbc, "lexiloom_baseline", mode="append")
        else:
            rows.write.mode("overwrite").parquet(f"{self.root}/baseline/{name}")

    def load_baseline(self, name: str) -> DataFrame:
        if self.jdbc:
            every = self.spark.read.jdbc(self.jdbc, "lexiloom_baseline").where(F.col("name") == name)
            last = every.agg(F.max("saved_at").alias("saved_at"))
            return every.join(F.broadcast(last), "saved_at").select("query", "ndcg", "recall", "precision5", "n_results")  # one row
        return self.spark.read.schema(schemas.METRICS).parquet(f"{self.root}/baseline/{name}")
