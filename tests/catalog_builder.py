"""Build small Catalog objects from Python rows for unit and golden tests."""

from __future__ import annotations

from catwarden.operators.catalog import Catalog

SCHEMAS = {
    "tables": "db_id bigint, table_name string",
    "columns": ("db_id bigint, table_name string, ordinal int, column_name string, sql_type string, "
                "bytes_per_char int, nullable boolean, default_sql string, computed_sql string"),
    "pks": "db_id bigint, table_name string, pk_name string",
    "pk_cols": "db_id bigint, table_name string, pk_name string, ordinal int, column_name string",
    "fks": ("db_id bigint, table_name string, fk_name string, ref_table string, support_index string, "
            "update_rule string, delete_rule string"),
    "fk_cols": "db_id bigint, table_name string, fk_name string, ordinal int, column_name string, ref_column string",
    "indexes": "db_id bigint, table_name string, index_name string, is_unique boolean, is_desc boolean",
    "index_cols": "db_id bigint, table_name string, index_name string, ordinal int, column_name string",
    "routines": "db_id bigint, kind string, name string, ignore_body boolean, source string",
    "databases": "db_id bigint, major int",
}


class DDL:
    """Accumulates catalog rows with a small declarative API."""

    def __init__(self, db_id: int = 1, major: int | None = 4):
        self.db = db_id
        self.rows = {k: [] for k in SCHEMAS}
        self.rows["databases"].append((db_id, major))

    def table(self, name, *cols):
        """cols: (name, type[, nullable[, default[, computed]]])"""
        self.rows["tables"].append((self.db, name))
        for i, c in enumerate(cols, 1):
            c = tuple(c) + (True, None, None)[len(c) - 2:]
            self.rows["columns"].append((self.db, name, i, c[0], c[1], 1, c[2], c[3], c[4]))
        return self

    def pk(self, table, name, *cols):
        self.rows["pks"].append((self.db, table, name))
        for i, c in enumerate(cols, 1):
            self.rows["pk_cols"].append((self.db, table, name, i, c))
        return self

    def fk(self, table, name, cols, ref_table, ref_cols, support=None, upd="RESTRICT", dele="RESTRICT"):
        self.rows["fks"].append((self.db, table, name, ref_table, support if support is not None else name, upd, dele))
        for i in range(max(len(cols), len(ref_cols))):
            self.rows["fk_cols"].append((self.db, table, name, i + 1, cols[i] if i < len(cols) else None,
                                         ref_cols[i] if i < len(ref_cols) else None))
        return self

    def index(self, table, name, cols, unique=False, desc=False):
        self.rows["indexes"].append((self.db, table, name, unique, desc))
        for i, c in enumerate(cols, 1):
            self.rows["index_cols"].append((self.db, table, name, i, c))
        return self

    def routine(self, kind, name, source, ignore_body=False):
        self.rows["routines"].append((self.db, kind, name, ignore_body, source))
        return self


def build(spark, *ddls: DDL) -> Catalog:
    merged = {k: [r for d in ddls for r in d.rows[k]] for k in SCHEMAS}
    frames = {k: spark.createDataFrame(merged[k], SCHEMAS[k]) for k in SCHEMAS}
    return Catalog(**frames)


def rich_sample(db_id: int = 1) -> DDL:
    """The 36-line risk showcase script, entered as catalog rows (a catalog
    read from a script always names the FK support index)."""
    d = DDL(db_id)
    d.table("CLIENTES", ("ID", "INTEGER", False), ("NOME", "VARCHAR(100)"), ("TIPO_INVALIDO", "TYPE_999"))
    d.table("PEDIDOS", ("ID", "INTEGER", False), ("CLIENTE_ID", "INTEGER"), ("CLIENTE_ID_AUX", "INTEGER"),
            ("VALOR", "NUMERIC(15,2)"))
    d.pk("PEDIDOS", "PK_PEDIDOS", "ID_COLUNA_INEXISTENTE")
    d.fk("PEDIDOS", "FK_PEDIDOS_CLIENTE", ["CLIENTE_ID"], "CLIENTES", ["ID"])
    d.fk("PEDIDOS", "FK_PEDIDOS_CLIENTE_DUP", ["CLIENTE_ID"], "CLIENTES", ["ID"])
    d.fk("PEDIDOS", "FK_PEDIDOS_CARD", ["CLIENTE_ID_AUX"], "CLIENTES", ["ID", "NOME"])
    d.fk("PEDIDOS", "FK_PEDIDOS_LOCAL_MISSING", ["CLIENTE_INEXISTENTE"], "CLIENTES", ["ID"])
    d.fk("PEDIDOS", "FK_PEDIDOS_REF_TABLE_MISSING", ["CLIENTE_ID_AUX"], "CLIENTES_X", ["ID"])
    d.fk("PEDIDOS", "FK_PEDIDOS_REF_COLUMN_MISSING", ["CLIENTE_ID_AUX"], "CLIENTES", ["ID_X"])
    d.table("LOG_EVENTOS")
    d.table("ITENS_PEDIDO", ("ID", "INTEGER"), ("PEDIDO_ID", "INTEGER"), ("PRODUTO_ID", "INTEGER"))
    d.fk("ITENS_PEDIDO", "FK_ITEM_PEDIDO", ["PEDIDO_ID"], "PEDIDOS", ["ID"])
    d.index("PEDIDOS", "IND_PEDIDOS_CLIENTE_A", ["CLIENTE_ID"])
    d.index("PEDIDOS", "IND_PEDIDOS_CLIENTE_B", ["CLIENTE_ID"])
    d.index("PEDIDOS", "IND_PEDIDOS_CLIENTE_VALOR", ["CLIENTE_ID", "VALOR"])
    d.index("PEDIDOS", "IND_PEDIDOS_SEM_COLUNA", [])
    d.index("PEDIDOS", "IND_PEDIDOS_COLUNA_INEXISTENTE", ["CLIENTE_ID_NAO_EXISTE"])
    return d


def plain_sample(db_id: int = 2) -> DDL:
    d = DDL(db_id)
    d.table("CLIENTES", ("ID", "INTEGER", False), ("NOME", "VARCHAR(100)"))
    d.table("PEDIDOS", ("ID", "INTEGER", False), ("CLIENTE_ID", "INTEGER"), ("VALOR", "NUMERIC(15,2)"))
    d.fk("PEDIDOS", "FK_PEDIDOS_CLIENTE", ["CLIENTE_ID"], "CLIENTES", ["ID"])
    d.index("PEDIDOS", "IND_PEDIDOS_CLIENTE_A", ["CLIENTE_ID"])
    d.index("PEDIDOS", "IND_PEDIDOS_CLIENTE_B", ["CLIENTE_ID"])
    return d


def clean_sample(db_id: int = 3) -> DDL:
    d = DDL(db_id)
    d.table("CLIENTE_OK", ("ID", "INTEGER", False), ("NOME", "VARCHAR(60)"))
    d.pk("CLIENTE_OK", "PK_CLIENTE_OK", "ID")
    d.table("PEDIDO_OK", ("ID", "INTEGER", False), ("CLIENTE_ID", "INTEGER"))
    d.pk("PEDIDO_OK", "PK_PEDIDO_OK", "ID")
    return d
