"""Raw exports, all columns as text, to tables of fixed columns and types.

Headers are compared in lower case, without accents, other characters as underscores; of
headers that meet, the first counts. Missing columns are null, values that don't fit are null.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from depotlane.functions import text as t
from depotlane.lineage import cut
from depotlane.operators import enrich
from depotlane.sources.files import header

#: Columns of each table, how they are read, and the raw headers they come from.
MOVEMENTS = {
    "movement_type": ("text", "tipo_movimiento"), "started_at": ("time", "fecha_inicio"), "completed_at": ("time", "fecha_finalizacion"), "sku": ("code", "articulo"),
    "sku_description": ("text", "denominacion_articulo"), "quantity": ("number", "cantidad"), "owner": ("code", "propietario"), "operator": ("text", "operario", "denominacion_operario"),
    "location": ("code", "ubicacion"), "pallet": ("code", "paleta"), "order_id": ("code", "pedido"), "external_order_id": ("code", "pedido_externo"), "client": ("code", "cliente"), "external_client": ("code", "cliente_externo"),
}
REQUEST_LINES = {
    "request_id": ("code", "id"), "request_code": ("code", "solicitud"), "service_date": ("day", "fecha_servicio", "fecha_de_servicio"), "created_at": ("time", "creacion_solicitud"), "order_id": ("code", "pedido"), "sku": ("code", "articulo"),
    "owner": ("code", "propietario"), "department": ("text", "departamento"), "line_status": ("text", "estado_linea"), "requested_quantity": ("number", "cant_solicitada"), "confirmed_quantity": ("number", "cant_confirmada"),
    "stored_quantity": ("number", "cant_almacenada"), "modified_at": ("time", "modificacion_linea"), "event_end_at": ("time", "fin_evento"), "deleted_at": ("time", "borrado_linea"), "line_type": ("text", "tipo"), "action": ("text", "accion"),
    "request_status": ("text", "estado"), "order_created_at": ("time", "creacion_pedido"), "last_modified_at": ("time", "ultima_modificacion"), "province": ("text", "provincia"), "generic_code": ("code", "codigo_generico"),
}
ITEMS = {
    "sku": ("code", "codigo"), "sku_name": ("text", "nombre"), "category": ("text", "categoria"), "created_at": ("time", "creacion"), "weight_kg": ("number", "kilos"), "m2": ("number", "m2"), "m3": ("number", "m3"),
    "length": ("number", "largo"), "width": ("number", "ancho"), "height": ("number", "alto"),
}
NOTES = {
    "item": ("code", "item"), "service_date": ("day", "fecha_servicio"), "event_concept": ("text", "concepto_denominacion_evento_asociado"), "description": ("text", "descripcion"), "service_code": ("code", "descripcion"),
    "requester": ("text", "solicitante"), "department": ("text", "dpto"), "pallets_in": ("number", "pales_in"), "boxes_in": ("number", "cajas_in"), "m3_in": ("number", "m3_in"), "pallets_out": ("number", "pales_out"),
    "boxes_out": ("number", "cajas_out"), "m3_out": ("number", "m3_out"), "urgency": ("text", "urgencia"), "holiday": ("text", "festivo"), "destination_province": ("text", "provincia_destino"), "weight_kg": ("number", "peso_kg_raw"), "volume_m3": ("number", "volumen"),
}
STOCK = {
    "owner": ("text", "denominacion_propietario"), "owner_code": ("code", "propie"), "sku": ("code", "art_y"), "sku_description": ("text", "denominacion"), "stock_quantity": ("number", "stock_pal"), "location": ("code", "ubicacion"), "occupancy_status": ("text", "ocupacion"),
}
LOOKUP = {
    "pallet": ("code", "paleta"), "sku": ("code", "articulo"), "completed_at": ("time", "fecha_finalizacion"), "quantity": ("number", "cantidad"), "owner": ("code", "propietario"),
    "order_id": ("code", "pedido"), "external_order_id": ("code", "pedido_externo"), "client": ("code", "cliente"), "external_client": ("code", "cliente_externo"),
}
READERS = {"text": t.normalize_text, "code": t.normalize_code, "number": t.number, "time": t.day_first, "day": lambda c: F.to_date(t.day_first(c))}
TYPES = {"text": "string", "code": "string", "number": "double", "time": "timestamp", "day": "date"}


def columns(raw: DataFrame, fields: Mapping[str, Sequence[str]]) -> DataFrame:
    """One projection of the raw table to the fields, each read from the first of its headers that is there."""
    known: dict[str, str] = {}
    for name in raw.columns:
        known.setdefault(re.sub("[^a-z0-9]+", "_", header(name)).strip("_"), name)

    def one(name: str, kind: str, *headers: str):
        found = next((known[h] for h in (name, *headers) if h in known), None)
        value = F.lit(None).cast(TYPES[kind]) if found is None else READERS[kind](F.col(f"`{found}`"))
        return value.alias(name)

    return raw.select(*[one(name, *how) for name, how in fields.items()])


def order_lookup(raw: DataFrame) -> DataFrame:
    """Orders by movement: rows with all keys and an order, whose keys stand for one set of values only."""
    read = cut(columns(raw, LOOKUP))  # filters on what is read would repeat all reading of text
    return enrich.unambiguous(read.where("external_order_id is not null"), enrich.LOOKUP_KEYS, enrich.LOOKUP_FILL)


def movements(raw: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """Movements with operational date, orders filled from a lookup (if one is given) and transaction id.

    lookup: rows with the columns of LOOKUP, as from `columns` or `order_lookup`.
    """
    out = columns(raw, MOVEMENTS).withColumn("d", t.operational("started_at", "completed_at")).select("*", "d.*").drop("d")
    if lookup is None:
        out = out.withColumns({"enriched": F.lit(0), "source": F.when(F.col("external_order_id").isNotNull(), "source")})
    else:
        out = enrich.fill_orders(out, lookup)
    out = out.withColumnsRenamed({"enriched": "external_order_id_enriched", "source": "external_order_id_source"})
    return out.withColumns({"service_code": F.col("external_order_id"), "basket_date": F.col("operational_date"), "transaction_id": F.concat("external_order_id", F.lit("|"), "owner")})


def request_lines(raw: DataFrame) -> DataFrame:
    """Request lines with flow, and service dates imputed where a request has one date only."""
    out = columns(raw, REQUEST_LINES).withColumn("service_flow", t.flow(F.col("action")))
    return enrich.impute_single(out, "generic_code", "service_date").withColumnRenamed("imputed", "service_date_imputed_from_request")


def items(raw: DataFrame) -> DataFrame:
    """Items with a code, one row each: the least by the other columns, so the choice is the same each time."""
    out = columns(raw, ITEMS).where("sku is not null")
    return enrich.best_row(out, ["sku"], [F.col(c) for c in out.columns if c != "sku"]).drop("rows")


def notes(raw: DataFrame) -> DataFrame:
    """Delivery notes."""
    return columns(raw, NOTES)


def stock(raw: DataFrame, snapshot_date: str | None) -> DataFrame:
    """Stock of one snapshot, rows with an item only."""
    return columns(raw, STOCK).where("sku is not null").withColumn("snapshot_date", F.lit(snapshot_date).cast("date"))
