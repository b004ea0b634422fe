"""Projections from remote documents to flat rows.

All are single ``select``s: Catalyst prunes the nested fields that are not
used down to the scan (nested-schema pruning).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.functions.exprs import first_truthy, long_address, nonblank, nz, short_address


def normalize_party(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Customer / vendor document -> sync entity row.

    Every NULL becomes '' except ``qb_id``; ``note`` is always ''.  ``keep``
    lists columns (tenant, position, ...) carried through unchanged.
    """
    keep = keep or []
    return docs.select(
        *[F.col(c) for c in keep],
        nz(F.col("DisplayName"), "").alias("name"),
        nz(F.col("PrimaryEmailAddr.Address"), "").alias("email"),
        nz(F.col("PrimaryPhone.FreeFormNumber"), "").alias("phone"),
        short_address("BillAddr").alias("address"),
        F.lit("").alias("note"),
        F.col("Id").alias("qb_id"),
    )


def company_profile(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """CompanyInfo -> (company_name, realm_id, company_address)."""
    keep = keep or []
    return docs.select(
        *[F.col(c) for c in keep],
        first_truthy(F.col("CompanyName"), F.col("LegalName"), "Unknown Company").alias("company_name"),
        first_truthy(F.col("Id"), "Unavailable").alias("realm_id"),
        long_address("CompanyAddr").alias("company_address"),
    )


def customer_search_row(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Id, display_name = DisplayName ?? GivenName ?? '', company_name ?? ''."""
    return docs.select(
        *[F.col(c) for c in keep or []],
        F.col("Id").alias("id"),
        nz(F.col("DisplayName"), F.col("GivenName"), "").alias("display_name"),
        nz(F.col("CompanyName"), "").alias("company_name"),
    )


def account_row(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Id, name ?? '', account_type ?? ''."""
    return docs.select(
        *[F.col(c) for c in keep or []],
        F.col("Id").alias("id"),
        nz(F.col("Name"), "").alias("name"),
        nz(F.col("AccountType"), "").alias("account_type"),
    )


def first_tax_rate_ref(docs: DataFrame) -> Column:
    """``SalesTaxRateList?.TaxRateDetail?.[0]?.TaxRateRef?.value ?? null``.

    ``get`` (not ``[0]``) is safe out of bounds under ANSI mode."""
    return F.get(F.col("SalesTaxRateList.TaxRateDetail"), 0)["TaxRateRef"]["value"]


def tax_code_row(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Id, name ?? '', tax_rate_ref_id (first detail's ref, or NULL)."""
    return docs.select(
        *[F.col(c) for c in keep or []],
        F.col("Id").alias("id"),
        nz(F.col("Name"), "").alias("name"),
        first_tax_rate_ref(docs).alias("tax_rate_ref_id"),
    )


def payment_method_row(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Id, name (as is), payment_type = Type ?? ''."""
    return docs.select(
        *[F.col(c) for c in keep or []],
        F.col("Id").alias("id"),
        nz(F.col("Name"), "").alias("name"),
        nz(F.col("Type"), "").alias("payment_type"),
    )


def service_item_row(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """P10: id, name ?? '', account_type = Type ?? ''."""
    return docs.select(
        *[F.col(c) for c in keep or []],
        F.col("Id").alias("id"),
        nz(F.col("Name"), "").alias("name"),
        nz(F.col("Type"), "").alias("account_type"),
    )


def mapping_row(docs: DataFrame) -> DataFrame:
    """Keep every column and add map_id, map_display_name
    (DisplayName || Name), map_company_name (CompanyName || FullyQualifiedName).

    Output names are prefixed: Spark column names are case-insensitive, so
    ``id`` / ``displayName`` would replace ``Id`` / ``DisplayName``.  Absent
    source columns are read as NULL.
    """
    cols = {c.lower() for c in docs.columns}

    def opt(name: str) -> Column:
        return F.col(name) if name.lower() in cols else F.lit(None).cast("string")

    return docs.select(
        "*",
        opt("Id").alias("map_id"),
        first_truthy(opt("DisplayName"), opt("Name")).alias("map_display_name"),
        first_truthy(opt("CompanyName"), opt("FullyQualifiedName")).alias("map_company_name"),
    )


def result_label(display_name: Column, name: Column) -> Column:
    """displayName ?? name ?? 'Unnamed'."""
    return nz(display_name, name, "Unnamed")


def result_meta(company_name: Column, account_type: Column, tax_rate_ref_id: Column,
                payment_type: Column) -> Column:
    """First non-empty of company_name, account_type,
    'Tax Rate Ref: ' + tax_rate_ref_id, payment_type; else ''."""
    return F.coalesce(
        F.nullif(company_name, F.lit("")),
        F.nullif(account_type, F.lit("")),
        F.nullif(F.concat(F.lit("Tax Rate Ref: "), F.nullif(tax_rate_ref_id, F.lit(""))), F.lit("")),
        F.nullif(payment_type, F.lit("")),
        F.lit(""),
    )


def mapping_action(current_qb_id: Column) -> tuple[Column, Column]:
    """(action, display): 'Remap ID'/'Map ID' and the id or 'Unmapped'."""
    mapped = nonblank(current_qb_id)
    return (F.when(mapped, F.lit("Remap ID")).otherwise(F.lit("Map ID")),
            F.when(mapped, current_qb_id).otherwise(F.lit("Unmapped")))
