"""Golden diff sample: 25 ordered commands, 17 created, 6 changed, 6 target-only, 2 warnings."""

from dataclasses import replace

from pyspark.sql import functions as F

from catwarden.operators import diff as D
from tests.catalog_builder import DDL, build

NN = False  # NOT NULL


def source():
    d = DDL(1)
    d.table("CLIENTES", ("ID", "INTEGER", NN), ("NOME", "VARCHAR(120)", NN),
            ("NOME_NORM", "VARCHAR(120)", True, None, "(UPPER(NOME))"), ("EMAIL", "VARCHAR(120)"),
            ("ATIVO", "SMALLINT", True, "DEFAULT 1"), ("DATA_CADASTRO", "TIMESTAMP", True, "DEFAULT CURRENT_TIMESTAMP"))
    d.pk("CLIENTES", "PK_CLIENTES", "ID")
    d.index("CLIENTES", "UX_CLIENTES_EMAIL", ["EMAIL"], unique=True)
    d.index("CLIENTES", "IX_CLIENTES_NOME", ["NOME"])
    d.table("PEDIDOS", ("ID", "INTEGER", NN), ("CLIENTE_ID", "INTEGER", NN), ("DATA_EMISSAO", "DATE", NN),
            ("VALOR_TOTAL", "NUMERIC(15,2)", True, "DEFAULT 0"), ("STATUS", "VARCHAR(20)", True, "DEFAULT 'ABERTO'"))
    d.pk("PEDIDOS", "PK_PEDIDOS", "ID")
    d.fk("PEDIDOS", "FK_PEDIDOS_CLIENTE", ["CLIENTE_ID"], "CLIENTES", ["ID"])
    d.index("PEDIDOS", "IX_PEDIDOS_CLIENTE", ["CLIENTE_ID"])
    d.index("PEDIDOS", "IX_PEDIDOS_DATA_STATUS", ["DATA_EMISSAO", "STATUS"])
    d.table("ITENS_PEDIDO", ("ID", "INTEGER", NN), ("PEDIDO_ID", "INTEGER", NN), ("PRODUTO_ID", "INTEGER", NN),
            ("QUANTIDADE", "NUMERIC(15,3)", NN), ("VALOR_UNITARIO", "NUMERIC(15,2)", NN), ("VALOR_TOTAL", "NUMERIC(15,2)", NN))
    d.pk("ITENS_PEDIDO", "PK_ITENS_PEDIDO", "ID")
    d.fk("ITENS_PEDIDO", "FK_ITENS_PEDIDO_PEDIDO", ["PEDIDO_ID"], "PEDIDOS", ["ID"], dele="CASCADE")
    d.index("ITENS_PEDIDO", "IX_ITENS_PEDIDO_PEDIDO", ["PEDIDO_ID"])
    d.index("ITENS_PEDIDO", "IX_ITENS_PEDIDO_PRODUTO", ["PRODUTO_ID"])
    d.table("PRODUTOS", ("ID", "INTEGER", NN), ("NOME", "VARCHAR(120)", NN), ("PRECO", "NUMERIC(15,2)", NN),
            ("ATIVO", "SMALLINT", True, "DEFAULT 1"))
    d.pk("PRODUTOS", "PK_PRODUTOS", "ID")
    d.index("PRODUTOS", "UX_PRODUTOS_NOME", ["NOME"], unique=True)
    return d


def target():
    d = DDL(1)
    d.table("CLIENTES", ("ID", "INTEGER", NN), ("NOME", "VARCHAR(80)", NN),
            ("NOME_NORM", "VARCHAR(120)", True, None, "(LOWER(NOME))"), ("TIPO", "VARCHAR(10)"))
    d.pk("CLIENTES", "PK_CLIENTES", "ID")
    d.index("CLIENTES", "IX_CLIENTES_TIPO", ["TIPO"])
    d.table("PEDIDOS", ("ID", "INTEGER", NN), ("CLIENTE_ID", "INTEGER"), ("DATA_EMISSAO", "DATE"),
            ("OBSERVACAO", "VARCHAR(255)"))
    d.pk("PEDIDOS", "PK_PEDIDOS", "ID")
    d.index("PEDIDOS", "IX_PEDIDOS_DATA", ["DATA_EMISSAO"])
    d.index("PEDIDOS", "IX_PEDIDOS_DATA_DUP", ["DATA_EMISSAO"])
    d.table("ITENS_PEDIDO", ("ID", "INTEGER", NN), ("PEDIDO_ID", "INTEGER"), ("QUANTIDADE", "NUMERIC(15,2)"))
    d.pk("ITENS_PEDIDO", "PK_ITENS_PEDIDO", "ID")
    d.index("ITENS_PEDIDO", "IX_ITENS_PEDIDO_QTD", ["QUANTIDADE"])
    d.table("PAGAMENTOS", ("ID", "INTEGER", NN), ("PEDIDO_ID", "INTEGER"), ("VALOR", "NUMERIC(15,2)"))
    d.pk("PAGAMENTOS", "PK_PAGAMENTOS", "ID")
    return d


EXPECTED_COMMANDS = [
    'CREATE TABLE "PRODUTOS" (\n    "ID" INTEGER NOT NULL,\n    "NOME" VARCHAR(120) NOT NULL,\n    "PRECO" NUMERIC(15,2) NOT NULL,\n    "ATIVO" SMALLINT DEFAULT 1\n);',
    'ALTER TABLE "CLIENTES" ADD "ATIVO" SMALLINT DEFAULT 1;',
    'ALTER TABLE "CLIENTES" ADD "DATA_CADASTRO" TIMESTAMP DEFAULT CURRENT_TIMESTAMP;',
    'ALTER TABLE "CLIENTES" ADD "EMAIL" VARCHAR(120);',
    'ALTER TABLE "PEDIDOS" ADD "STATUS" VARCHAR(20) DEFAULT \'ABERTO\';',
    'ALTER TABLE "PEDIDOS" ADD "VALOR_TOTAL" NUMERIC(15,2) DEFAULT 0;',
    'ALTER TABLE "ITENS_PEDIDO" ADD "PRODUTO_ID" INTEGER NOT NULL;',
    'ALTER TABLE "ITENS_PEDIDO" ADD "VALOR_TOTAL" NUMERIC(15,2) NOT NULL;',
    'ALTER TABLE "ITENS_PEDIDO" ADD "VALOR_UNITARIO" NUMERIC(15,2) NOT NULL;',
    'ALTER TABLE "CLIENTES" ALTER COLUMN "NOME" TYPE VARCHAR(120);',
    'ALTER TABLE "PEDIDOS" ALTER COLUMN "CLIENTE_ID" SET NOT NULL;',
    'ALTER TABLE "PEDIDOS" ALTER COLUMN "DATA_EMISSAO" SET NOT NULL;',
    'ALTER TABLE "ITENS_PEDIDO" ALTER COLUMN "PEDIDO_ID" SET NOT NULL;',
    'ALTER TABLE "ITENS_PEDIDO" ALTER COLUMN "QUANTIDADE" TYPE NUMERIC(15,3);',
    'ALTER TABLE "ITENS_PEDIDO" ALTER COLUMN "QUANTIDADE" SET NOT NULL;',
    'ALTER TABLE "PRODUTOS" ADD CONSTRAINT "PK_PRODUTOS" PRIMARY KEY ("ID");',
    'CREATE INDEX "IX_CLIENTES_NOME" ON "CLIENTES" ("NOME");',
    'CREATE UNIQUE INDEX "UX_CLIENTES_EMAIL" ON "CLIENTES" ("EMAIL");',
    'CREATE UNIQUE INDEX "UX_PRODUTOS_NOME" ON "PRODUTOS" ("NOME");',
    'CREATE INDEX "IX_PEDIDOS_CLIENTE" ON "PEDIDOS" ("CLIENTE_ID");',
    'CREATE INDEX "IX_PEDIDOS_DATA_STATUS" ON "PEDIDOS" ("DATA_EMISSAO", "STATUS");',
    'CREATE INDEX "IX_ITENS_PEDIDO_PEDIDO" ON "ITENS_PEDIDO" ("PEDIDO_ID");',
    'CREATE INDEX "IX_ITENS_PEDIDO_PRODUTO" ON "ITENS_PEDIDO" ("PRODUTO_ID");',
    'ALTER TABLE "PEDIDOS" ADD CONSTRAINT "FK_PEDIDOS_CLIENTE" FOREIGN KEY ("CLIENTE_ID") REFERENCES "CLIENTES" ("ID");',
    'ALTER TABLE "ITENS_PEDIDO" ADD CONSTRAINT "FK_ITENS_PEDIDO_PEDIDO" FOREIGN KEY ("PEDIDO_ID") REFERENCES "PEDIDOS" ("ID") ON DELETE CASCADE;',
]


def test_diff_sample_commands_in_order(spark):
    r = D.diff(build(spark, source()), build(spark, target()))
    got = [row.sql for row in r.commands.collect()]
    assert got == EXPECTED_COMMANDS


def test_diff_sample_buckets(spark):
    r = D.diff(build(spark, source()), build(spark, target()))
    items = r.items.collect()
    by = {}
    for it in items:
        by.setdefault(it.bucket, []).append(it)
    assert {k: len(v) for k, v in by.items()} == {"created": 17, "changed": 6, "target_only": 6, "warning": 2}
    warn = sorted((w.object_type, w.name, w.attr) for w in by["warning"])
    assert warn == [("COLUMN", "NOME_NORM", "COMPUTED"),
                    ("INDEX", "IX_PEDIDOS_DATA_DUP", "DUPLICATE_TARGET: IX_PEDIDOS_DATA <-> IX_PEDIDOS_DATA_DUP | N|A|DATA_EMISSAO")]
    s = D.diff_summary(r).collect()[0]
    assert (s.created, s.changed, s.target_only, s.warning, s.commands) == (17, 6, 6, 2, 25)


def test_apply_then_rediff_converges(spark):
    src, tgt = build(spark, source()), build(spark, target())
    assert D.convergence(src, tgt).count() == 0


def test_named_kinds_unique_check_sequence_view_domain(spark):
    s = build(spark, DDL(1).table("T", ("A", "INTEGER")))
    t = build(spark, DDL(1).table("T", ("A", "INTEGER")))
    mk = spark.createDataFrame
    s = replace(s, extras={
        "uniques": mk([(1, "T", "UQ_A", ["A"]), (1, "T", "UQ_NEW", ["A"])], "db_id long, table_name string, name string, cols array<string>"),
        "checks": mk([(1, "T", "CK_A", "CHECK (A >\t0)"), (1, "T", "INTEG_7", "A < 9")], "db_id long, table_name string, name string, check_sql string"),
        "sequences": mk([(1, "S_A"), (1, "S_NEW")], "db_id long, name string"),
        "views": mk([(1, "V", "select 1 from rdb$database"), (1, "V2", "SELECT 2")], "db_id long, name string, select_sql string")},
        domains=mk([(1, "D_A", "INTEGER", 1, False, None, None), (1, "RDB$1", "INTEGER", 1, True, None, None)],
                   "db_id long, name string, sql_type string, bytes_per_char int, nullable boolean, default_sql string, check_sql string"))
    t = replace(t, extras={
        "uniques": mk([(1, "T", "uq_a", ["A", "B"]), (1, "T", "UQ_OLD", ["A"])], "db_id long, table_name string, name string, cols array<string>"),
        "checks": mk([(1, "T", "CK_A", "check (a > 0)\r\n")], "db_id long, table_name string, name string, check_sql string"),
        "sequences": mk([(1, "S_A"), (1, "S_OLD")], "db_id long, name string"),
        "views": mk([(1, "V", "SELECT 1 FROM RDB$DATABASE ")], "db_id long, name string, select_sql string")},
        domains=mk([(1, "D_A", "INTEGER", 1, True, None, None)],
                   "db_id long, name string, sql_type string, bytes_per_char int, nullable boolean, default_sql string, check_sql string"))
    r = D.diff(s, t, include_domains=True)
    items = sorted((i.bucket, i.object_type, i.name) for i in r.items.collect())
    assert items == [("created", "CHECK", "INTEG_7"), ("created", "SEQUENCE", "S_NEW"), ("created", "UNIQUE", "UQ_NEW"),
                     ("created", "VIEW", "V2"), ("target_only", "SEQUENCE", "S_OLD"), ("target_only", "UNIQUE", "UQ_OLD"),
                     ("warning", "DOMAIN", "D_A"), ("warning", "UNIQUE", "UQ_A")]
    cmds = sorted((c["class"], c.sql) for c in r.commands.collect())
    assert cmds == [(16, 'CREATE SEQUENCE "S_NEW";'), (25, 'CREATE VIEW "V2" AS SELECT 2;'),
                    (42, 'ALTER TABLE "T" ADD CONSTRAINT "UQ_NEW" UNIQUE ("A");'),
                    (43, 'ALTER TABLE "T" ADD CHECK (A < 9);')]


def test_fk_depth_cycles_and_self_reference(spark):
    from catwarden.operators.graph import fk_depth
    d = (DDL(1).table("A", ("ID", "INTEGER")).table("B", ("ID", "INTEGER")).table("C", ("ID", "INTEGER"))
         .table("S", ("ID", "INTEGER")).table("X", ("ID", "INTEGER")).table("Y", ("ID", "INTEGER"))
         .fk("B", "FK_B_A", ["ID"], "A", ["ID"]).fk("C", "FK_C_B", ["ID"], "B", ["ID"])
         .fk("C", "FK_C_GHOST", ["ID"], "GHOST", ["ID"]).fk("S", "FK_S_S", ["ID"], "S", ["ID"])
         .fk("X", "FK_X_Y", ["ID"], "Y", ["ID"]).fk("Y", "FK_Y_X", ["ID"], "x", ["ID"]))
    got = {r.table_name: (r.depth, r.cyclic) for r in fk_depth(build(spark, d)).collect()}
    assert got == {"A": (0, False), "B": (1, False), "C": (2, False), "S": (1, False), "X": (1, True), "Y": (1, True)}
