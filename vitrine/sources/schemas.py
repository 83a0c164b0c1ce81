"""Tables of the store: columns, keys and references."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Table:
    name: str
    columns: dict[str, str]
    key: str | tuple[str, ...] | None = None
    required: tuple[str, ...] = ()
    references: dict[str, tuple[str, str]] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)


TABLES = {
    t.name: t
    for t in (
        Table(
            "categories",
            {"category_id": "long", "name": "string", "description": "string"},
            key="category_id",
            required=("name",),
        ),
        Table(
            "products",
            {
                "product_id": "long",
                "name": "string",
                "category_id": "long",
                "price_brl": "decimal(12,2)",
                "description": "string",
                "stock_quantity": "int",
                "status": "string",
                "specs_raw": "string",
                "created_at": "date",
            },
            key="product_id",
            required=("name", "price_brl", "stock_quantity", "status"),
            references={"category_id": ("categories", "category_id")},
            defaults={"stock_quantity": 0},
        ),
        Table(
            "customers",
            {"customer_id": "long", "name": "string", "phone": "string", "email": "string", "city": "string"},
            key="customer_id",
            required=("name",),
        ),
        Table(
            "orders",
            {
                "order_id": "long",
                "customer_id": "long",
                "order_date": "date",
                "status": "string",
                "total_brl": "decimal(12,2)",
                "payment_method": "string",
                "tracking_code": "string",
                "estimated_delivery": "date",
                "notes": "string",
            },
            key="order_id",
            references={"customer_id": ("customers", "customer_id")},
        ),
        Table(
            "order_items",
            {"order_id": "long", "product_id": "long", "quantity": "int"},
            references={"order_id": ("orders", "order_id"), "product_id": ("products", "product_id")},
        ),
        Table(
            "promotions",
            {
                "promotion_id": "long",
                "product_id": "long",
                "discount_percent": "decimal(5,2)",
                "description": "string",
                "is_active": "boolean",
            },
            key="promotion_id",
            required=("is_active",),
            references={"product_id": ("products", "product_id")},
            defaults={"is_active": False},
        ),
    )
}

#: Tables that are not loaded from feeds: the chunk table and the session registry.
STATE_TABLES = {
    t.name: t
    for t in (
        Table(
            "policy_chunks",
            {"doc_id": "long", "chunk_no": "int", "section": "string", "text": "string"},
            key=("doc_id", "chunk_no"),
            required=("section", "text"),
        ),
        Table(
            "sessions",
            {"session_id": "string", "first_message_id": "long", "created_at": "timestamp"},
            key="session_id",
            required=("created_at",),
        ),
        Table(
            "messages",
            {
                "session_id": "string",
                "message_id": "long",
                "role": "string",
                "content": "string",
                "created_at": "timestamp",
            },
            key=("session_id", "message_id"),
            required=("session_id", "role", "content", "created_at"),
            references={"session_id": ("sessions", "session_id")},
        ),
    )
}

# Source columns whose name differs from the table's.
SOURCE_NAMES = {"specs_raw": "specs"}
