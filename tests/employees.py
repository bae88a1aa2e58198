"""The employee table and its state after each step."""

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("id", T.IntegerType(), False),
        T.StructField("nome", T.StringType(), False),
        T.StructField("departamento", T.StringType()),
        T.StructField("cargo", T.StringType()),
        T.StructField("salario", T.DoubleType()),
        T.StructField("data_admissao", T.StringType()),
    ]
)

# Fixed values.
ROWS = [
    (1, "Ana Silva", "Engenharia de Dados", "Engenheira Sênior", 8500.0, "2022-03-15"),
    (2, "Bruno Costa", "Arquitetura", "Arquiteto de Dados", 9200.0, "2021-07-01"),
    (3, "Carla Mendes", "Produto", "Product Manager", 7800.0, "2023-01-20"),
    (4, "Diego Rocha", "Engenharia de Dados", "Engenheiro Pleno", 6900.0, "2020-11-10"),
    (5, "Evelyn Santos", "Engenharia de Dados", "Engenheira de ML", 10500.0, "2019-05-05"),
    (6, "Felipe Nunes", "DevOps", "SRE", 8100.0, "2021-09-14"),
    (7, "Gabriela Lima", "Arquitetura", "Arquiteta de Soluções", 9800.0, "2018-03-22"),
    (8, "Henrique Matos", "Produto", "UX Researcher", 6500.0, "2024-02-01"),
]
RAISED = {1: 9350.0, 4: 7590.000000000001, 5: 11550.000000000002}
AFTER_UPDATE = [(*r[:4], RAISED.get(r[0], r[4]), r[5]) for r in ROWS]
AFTER_DELETE = [r for r in AFTER_UPDATE if r[2] != "Produto"]

IN_DATA_ENGINEERING = "departamento = 'Engenharia de Dados'"
IN_PRODUCT = "departamento = 'Produto'"
RAISE = {"salario": "salario * 1.10"}
