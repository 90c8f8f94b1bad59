"""Alias tables: built-in and project terms, their merging, and ordered query expansion."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

# A term and what else it may be called.
_BUILT_IN = """
mongodb: docdb documentdb document_db mongo aws_docdb
docdb: mongodb documentdb mongo
documentdb: mongodb docdb mongo
postgres: rds aurora postgresql aws_db_instance aws_rds
postgresql: postgres rds aurora aws_db_instance
rds: postgres aurora postgresql database aws_db_instance
aurora: postgres rds postgresql aws_rds
mysql: rds aurora aws_db_instance database
redis: elasticache elastic_cache aws_elasticache
elasticache: redis elastic_cache
kafka: msk aws_msk kinesis
msk: kafka aws_msk
s3: aws_s3 bucket storage
storage: s3 aws_s3 bucket efs
lambda: aws_lambda serverless function
serverless: lambda aws_lambda
api: apigateway api_gateway aws_apigateway gateway
apigateway: api gateway aws_apigateway
queue: sqs aws_sqs rabbitmq
sqs: queue aws_sqs
sns: notification topic aws_sns
notification: sns aws_sns
ecs: aws_ecs docker container fargate
docker: ecs ecr container fargate
kubernetes: eks k8s aws_eks
eks: kubernetes k8s aws_eks
k8s: kubernetes eks
vpc: aws_vpc network subnet cidr
network: vpc aws_vpc subnet sg security_group
iam: aws_iam role policy permission
security: iam sg security_group waf kms
monitoring: cloudwatch alarm dashboard metrics grafana
cloudwatch: monitoring alarm metrics aws_cloudwatch
cicd: pipeline deploy github_actions codebuild codepipeline
pipeline: cicd codebuild codepipeline deploy
dns: route53 aws_route53 domain
route53: dns domain aws_route53
certificate: acm aws_acm tls ssl
acm: certificate tls ssl aws_acm
secret: ssm aws_ssm vault secrets_manager
ssm: secret parameter_store aws_ssm
module: modules terraform_module
provider: terraform_provider aws_provider
variable: terraform_variable input tfvar
output: terraform_output
data: data_source terraform_data
locals: terraform_locals local_variable
endpoint: route router handler url api
route: endpoint router handler url
handler: route endpoint router
fastapi: api route endpoint router
webhook: webhooks callback hook
task: taskiq background job worker queue celery
job: task taskiq background
background: task taskiq async worker
model: models document schema entity table
document: model models beanie mongodb
schema: model pydantic basemodel dto
enum: strenum intenum enums values
test: tests pytest spec unittest
tests: test pytest spec
auth: authentication authorization login session
authentication: auth login session
"""

Table = Mapping[str, Sequence[str]]
BUILT_IN: dict[str, list[str]] = {k.strip(): v.split() for k, v in (line.split(":") for line in _BUILT_IN.strip().splitlines())}


def merged(*tables: Table) -> dict[str, list[str]]:
    """One table; later ones extend earlier ones, in order, and no term is its own alias."""
    out: dict[str, list[str]] = {}
    for t in tables:
        for term, names in t.items():
            out[term] = list(dict.fromkeys([*out.get(term, []), *(n for n in names if n != term)]))
    return out


def load(path: str | Path) -> dict[str, list[str]]:
    """A YAML file of ``term: [alias, ...]`` (or one alias); anything unusable gives no terms."""
    import yaml

    try:
        data = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    except (OSError, UnicodeDecodeError, yaml.YAMLError):
        return {}
    out: dict[str, list[str]] = {}
    for term, names in data.items() if isinstance(data, dict) else ():
        names = [names] if isinstance(names, str) else names
        if isinstance(term, str) and isinstance(names, list):
            found = [str(n).lower() for n in names if isinstance(n, (str, int, float))]
            if found:
                out[term.lower()] = found
    return out


def project_table(folder: str | Path) -> dict[str, list[str]]:
    """Built-in terms with the project's generated and then its curated ones."""
    return merged(BUILT_IN, load(Path(folder) / "aliases.auto.yaml"), load(Path(folder) / "aliases.yaml"))


def expanded(query: Column, table: Table = BUILT_IN) -> Column:
    """White-space tokens of the query, each followed by its aliases; the first of equal words stays."""
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]) if table else F.lit(None).cast("map<string,array<string>>")
    words = F.filter(F.split(F.lower(F.coalesce(query, F.lit(""))), "\\s+"), lambda t: t != "")
    return F.array_join(F.array_distinct(F.flatten(F.transform(words, lambda t: F.concat(F.array(t), F.coalesce(F.try_element_at(known, t), F.array().cast("array<string>")))))), " ")


def sql_expanded(query: str, table: Table = BUILT_IN) -> str:
    known = "MAP {" + ", ".join(f"'{k}': [{', '.join(repr(x) for x in v)}]" for k, v in table.items()) + "}"
    words = f"list_filter(string_split_regex(lower(coalesce({query}, '')), '\\s+'), lambda t: t <> '')"
    flat = f"flatten(list_transform({words}, lambda t: list_concat([t], coalesce({known}[t], []))))"
    return f"array_to_string(list_transform(list_filter(list_zip({flat}, range(len({flat}))), lambda z: list_position({flat}, z[1]) = z[2] + 1), lambda z: z[1]), ' ')"
