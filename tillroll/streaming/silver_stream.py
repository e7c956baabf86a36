"""Continuous Bronze to Silver for the extracts whose cleaning is row-wise.

Customer records are not among them: which record of a customer is the latest depends on all
of them, so that step stays a batch job.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from tillroll.operators import silver
from tillroll.sources import extracts

ROW_WISE = {
    "crm_prd_info": silver.clean_crm_prd_info,
    "crm_sales_details": silver.clean_crm_sales_details,
    "erp_cust_az12": silver.clean_erp_cust_az12,
    "erp_loc_a101": silver.clean_erp_loc_a101,
    "erp_px_cat_g1v2": silver.clean_erp_px_cat,
}


def stream_silver(
    spark: SparkSession, name: str, folder: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Clean what has arrived so far, append it to ``out`` as Parquet, and stop."""
    cleaned = ROW_WISE[name](extracts.stream_bronze(spark, name, folder))
    return (
        cleaned.writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
