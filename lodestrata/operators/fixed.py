"""Names, patterns and numbers that results must share with the surveyed behaviour, stated as they are."""

from __future__ import annotations

# Languages by file suffix, folders that hold no sources, and files that a handler isn't looked for in.
LANGUAGES = {
    ".py": "python", ".js": "node", ".mjs": "node", ".cjs": "node", ".ts": "typescript", ".tsx": "typescript",
    ".java": "java", ".cs": "csharp", ".cbl": "cobol", ".cob": "cobol", ".go": "go", ".rb": "ruby",
}
SKIPPED_FOLDERS = (".git", ".venv", "__pycache__", "node_modules", "dist", "build", ".pytest_cache", ".mypy_cache", "target")
BUILD_MANIFESTS = ("pom.xml", "build.gradle", "build.gradle.kts")
PYTHON_HANDLER = r"^\s*def\s+(?:lambda_)?handler\s*\(\s*event"
SCRIPT_HANDLER = r"(?:exports|module\.exports)\.handler\s*=|export\s+(?:const|async\s+function|function)\s+handler\b"
JAVA_MARKERS = ("RequestHandler", "RequestStreamHandler")
CSHARP_MARKERS = ("FunctionHandler", "LambdaFunction", "Amazon.Lambda.Core")
COBOL_SUFFIXES = (".cbl", ".cob", ".cobol")

# Patterns of legacy SDK use, of target entry points and of old handlers; the files that are looked at.
SDK_IMPORT = (
    r"(?:^\s*import\s+boto3\b|^\s*from\s+boto3|^\s*import\s+botocore|^\s*from\s+botocore|@aws-sdk/"
    r"|software\.amazon\.awssdk|com\.amazonaws|Amazon\.[A-Z]\w+\.)"
)
SDK_CALL = (
    r"\b(?:boto3\.(?:client|resource)\(|new\s+(?:SQS|SNS|S3|DynamoDB|Kinesis|Lambda|SFN|EventBridge)Client\b"
    r"|(?:Sqs|Sns|S3|DynamoDb|Kinesis|Lambda|Sfn|EventBridge)Client\.builder\b|new\s+Amazon[A-Z]\w+Client\b)"
)
TARGET_DECORATOR = r"@app\.(?:route|service_bus_queue_trigger|event_grid_trigger|blob_trigger|timer_trigger|schedule)"
TARGET_IMPORT = r"(?:^\s*(?:from|import)\s+azure\.|from\s+azure\.)"
OLD_HANDLER = r"def\s+lambda_handler\s*\(|exports\.handler\s*=|RequestHandler<|FunctionHandler\b"
TARGET_FILES = ("function_app.py", "requirements.txt")
SCANNED_SUFFIXES = (".py", ".js", ".mjs", ".ts", ".java", ".cs")
UNSCANNED_FOLDERS = ("node_modules", ".venv", "__pycache__", "target")

# SDK factories of Python, the keyword arguments that name a resource, and kinds of resources by service.
FACTORIES = ("client", "resource")
FACTORY_MODULES = ("boto3", "aioboto3")
NAMING_ARGUMENTS = ("TableName", "Bucket", "QueueUrl", "TopicArn", "StreamName", "SecretId", "FunctionName")
RESOURCE_KINDS = {
    "dynamodb": "table", "s3": "bucket", "sqs": "queue", "sns": "topic", "kinesis": "stream", "secretsmanager": "secret",
    "lambda": "function", "stepfunctions": "state_machine", "eventbridge": "rule",
}

# Imports and client constructions of the other languages, services by client class, external modules.
NODE_REQUIRE = r"""^\s*(?:const|let|var)\s+(?:\{[^}]+\}|\w+)\s*=\s*require\(\s*['"]([^'"]+)['"]\s*\)"""
NODE_IMPORT = r"""^\s*import\s+[^'"]+\s+from\s+['"]([^'"]+)['"]"""
TYPESCRIPT_IMPORT = r"""^\s*import\s+[^;]+\s+from\s+['"]([^'"]+)['"]"""
SCRIPT_CLIENT = r"""new\s+(\w+Client)\s*\("""
JAVA_IMPORT = r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"
JAVA_BUILDER = r"""(\w+Client)\.builder\(\)"""
JAVA_CLIENT = r"""new\s+(\w+Client)\s*\("""
CSHARP_USING = r"^\s*using\s+([\w.]+)\s*;"
CSHARP_CLIENT = r"""new\s+(Amazon\w+Client)\s*\("""
CLIENT_SERVICES = {
    "SQSClient": "sqs", "SNSClient": "sns", "S3Client": "s3", "DynamoDBClient": "dynamodb", "DynamoDBDocumentClient": "dynamodb",
    "SFNClient": "stepfunctions", "EventBridgeClient": "eventbridge", "SecretsManagerClient": "secretsmanager",
    "KinesisClient": "kinesis", "LambdaClient": "lambda", "SSMClient": "ssm", "CognitoIdentityProviderClient": "cognito",
    "SqsClient": "sqs", "SnsClient": "sns", "DynamoDbClient": "dynamodb", "SfnClient": "stepfunctions",
    "AmazonSQSClient": "sqs", "AmazonSNSClient": "sns", "AmazonS3Client": "s3", "AmazonDynamoDBClient": "dynamodb",
    "AmazonSimpleNotificationServiceClient": "sns", "AmazonStepFunctionsClient": "stepfunctions",
    "AmazonEventBridgeClient": "eventbridge", "AmazonSecretsManagerClient": "secretsmanager", "AmazonKinesisClient": "kinesis",
    "AmazonLambdaClient": "lambda",
}
JAVA_EXTERNAL = ("java.", "javax.", "jakarta.", "org.", "com.amazonaws.", "software.amazon.", "com.google.")
CSHARP_EXTERNAL = ("System.", "Microsoft.", "Amazon.", "AWSSDK.", "Newtonsoft.")

# What an SDK operation does to which kind of resource: (service, kind, default access, operations by access).
ACCESS = (
    (
        "dynamodb", "dynamodb_table", "reads",
        {
            "writes": ("put_item", "update_item", "delete_item", "batch_write_item", "transact_write_items"),
            "reads": ("get_item", "query", "scan", "batch_get_item", "transact_get_items", "describe_table"),
        },
    ),
    (
        "s3", "s3_bucket", "reads",
        {
            "writes": ("put_object", "delete_object", "copy_object", "complete_multipart_upload", "upload_file", "upload_fileobj"),
            "reads": (
                "get_object", "head_object", "list_objects", "list_objects_v2", "list_buckets", "head_bucket",
                "download_file", "download_fileobj",
            ),
        },
    ),
    (
        "sqs", "sqs_queue", None,
        {
            "produces": ("send_message", "send_message_batch"),
            "consumes": ("receive_message", "delete_message", "delete_message_batch", "change_message_visibility"),
        },
    ),
    ("sns", "sns_topic", None, {"produces": ("publish", "publish_batch")}),
    ("kinesis", "kinesis_stream", None, {"produces": ("put_record", "put_records"), "consumes": ("get_records", "get_shard_iterator")}),
    (
        "secretsmanager", "secrets_manager_secret", None,
        {"reads": ("get_secret_value", "describe_secret"), "writes": ("put_secret_value", "update_secret")},
    ),
    ("lambda", "lambda_function", None, {"invokes": ("invoke", "invoke_async")}),
    ("stepfunctions", "step_function", None, {"invokes": ("start_execution", "start_sync_execution")}),
    ("eventbridge", "event_rule", None, {"produces": ("put_events",)}),
    ("ssm", "ssm_parameter", None, {"reads": ("get_parameter", "get_parameters"), "writes": ("put_parameter", "delete_parameter")}),
)
#: Edges of the dependency graph and of the knowledge graph by access.
HINT_EDGES = {"reads": "reads_from", "writes": "writes_to", "produces": "queues_to", "consumes": "reads_from", "invokes": "invokes"}
GRAPH_EDGES = {"reads": "reads", "writes": "writes", "produces": "writes", "consumes": "reads", "invokes": "calls"}

# Event sources of serverless functions: (event types, kind, the property that names the resource, whether it is an ARN).
EVENTS = (
    (("sqs",), "queue", "Queue", True),
    (("sns", "topic"), "topic", "Topic", True),
    (("dynamodb", "stream"), "table", "Stream", True),
    (("s3",), "bucket", "Bucket", False),
    (("schedule",), "schedule", "Schedule", False),
    (("api", "apigateway", "http"), "api", "Path", False),
)
ARN_KINDS = {"sqs": "queue", "sns": "topic", "dynamodb": "table", "kinesis": "stream"}
FUNCTION_TYPE, MAPPING_TYPE = "AWS::Serverless::Function", "AWS::Lambda::EventSourceMapping"

# The words of an operation by which an edge has its kind, in this order: (services or all, words, kind).
EDGE_KINDS = (
    (("sqs", "service-bus"), ("send", "publish"), "queues_to"),
    (("sns", "event-grid", "eventbridge"), ("publish", "put"), "publishes_to"),
    ((), ("get", "read", "scan", "query"), "reads_from"),
    ((), ("put", "write", "update", "insert", "delete"), "writes_to"),
)

# Target services by source service.
SERVICES = (
    ("sqs", "service-bus-queue"), ("sns", "event-grid-topic"), ("dynamodb", "cosmos-db-sql"), ("dynamodb-streams", "cosmos-db-change-feed"),
    ("s3", "blob-storage"), ("s3-events", "event-grid-system-topic-blob"), ("kinesis", "event-hubs"), ("stepfunctions", "durable-functions"),
    ("eventbridge", "event-grid"), ("secretsmanager", "key-vault-secrets"), ("ssm-parameter-store", "app-configuration"),
    ("lambda-invoke", "durable-functions-activity"), ("api-gateway", "apim-or-function-http-trigger"), ("cloudwatch-logs", "app-insights"),
    ("cloudwatch-metrics", "azure-monitor-metrics"), ("iam-role", "managed-identity"), ("sts-assumerole", "managed-identity-token"),
    ("cognito", "entra-id"),
)

# Job control, one card a match; letters in either case.
JOB_CARD = r"^//(\S+)\s+JOB\b"
EXEC_CARD = r"^//(\S+)\s+EXEC\s+.*?\bPGM\s*=\s*([A-Za-z][\w#@$-]*)"
DD_CARD = r"^//(\S+)\s+DD\b(.*)$"
DATASET_NAME = r"\bDSN(?:AME)?\s*=\s*([A-Za-z0-9@#$.\-()]+)"
SYSOUT_CLASS = r"\bSYSOUT\s*=\s*([A-Za-z0-9*])"

# COBOL; letters in either case.
PROGRAM_ID = r"^\s*PROGRAM-ID\s*\.\s*([A-Za-z][\w-]*)"
COPY_IMPORT = r"^\s*COPY\s+([A-Za-z][\w-]*)\b"
COPY_LINE = r"^\s*COPY\s+([A-Za-z][\w-]*)\s*\.\s*$"
CALL_LITERAL = r"\bCALL\s+['\"]([A-Za-z][\w-]*)['\"]"
EXEC_SQL = r"EXEC\s+SQL\s+(.*?)\s+END-EXEC"
EXEC_CICS = r"EXEC\s+CICS\s+(.*?)\s+END-EXEC"
SECTION_HEADER = r"^\s*([A-Za-z][\w-]*)\s+SECTION\s*\."
PARAGRAPH_HEADER = r"^\s*([A-Za-z][\w-]*)\s*\.\s*$"
SELECT_ASSIGN = r"\bSELECT\s+([A-Za-z][\w-]*)\s+ASSIGN\s+TO\s+([A-Za-z][\w-]*)"
PROCEDURE_DIVISION = r"\bPROCEDURE\s+DIVISION\b"
PROCEDURE_USING = r"\bPROCEDURE\s+DIVISION\s+USING\s+([A-Za-z][\w\s,-]*?)(?:\.|$)"
PERFORM = r"\bPERFORM\s+([A-Za-z][\w-]*)(?:\s+THRU\s+([A-Za-z][\w-]*))?"
FILE_ACCESS = r"\b(READ|WRITE|REWRITE|DELETE)\s+([A-Za-z][\w-]*)"
REDEFINES = r"\bREDEFINES\s+([A-Za-z][\w-]*)"
OCCURS = r"\bOCCURS\s+(\d+)(?:\s+TO\s+(\d+))?\s+TIMES(?:\s+DEPENDING\s+ON\s+([A-Za-z][\w-]*))?"
READING_VERBS = ("SELECT", "FETCH", "DECLARE")
TERMINATORS = (
    "END-IF", "END-EVALUATE", "END-PERFORM", "END-READ", "END-WRITE", "END-REWRITE", "END-DELETE", "END-START",
    "END-CALL", "END-INVOKE", "END-RETURN", "END-COMPUTE", "END-ADD", "END-SUBTRACT", "END-MULTIPLY", "END-DIVIDE",
    "END-STRING", "END-UNSTRING", "END-SEARCH", "END-ACCEPT", "END-DISPLAY", "END-EXEC", "STOP", "EXIT", "END", "GOBACK",
)
BOOK_HEADERS = (
    "identification division", "program-id", "environment division", "data division", "working-storage section",
    "file section", "procedure division",
)
BOOK_FOLDERS = ("copybooks", "copybook", "cpy", "copy", "")
BOOK_SUFFIXES = (".cpy", ".copy", ".cob", ".cobol")

# Fences with files, and the ways in which a path is told, in the order in which they are tried.
FENCE = r"```([^\n]*)\n(.*?)```"
FENCE_PATH = r"path=(\S+)"
BODY_PATHS = (
    r"(?m)^\s*path=(\S+)\s*$",
    r"<!--\s*path=(\S+?)\s*-->",
    r"//\s*path=(\S+)",
    r"#\s*path=(\S+)",
    r"/\*\s*path=(\S+?)\s*\*/",
)

# Rates in USD per million tokens (input, output), in the order in which prefixes are tried.
PRICING = (
    ("gpt-5.4-mini", 0.15, 0.60), ("gpt-5", 2.50, 10.00), ("gpt-4o-mini", 0.15, 0.60), ("gpt-4o", 2.50, 10.00),
    ("gpt-4.1-mini", 0.40, 1.60), ("gpt-4.1", 2.00, 8.00), ("claude-opus-4-7", 15.00, 75.00), ("claude-sonnet-4-6", 3.00, 15.00),
    ("claude-sonnet-4-5", 3.00, 15.00), ("claude-haiku-4-5", 1.00, 5.00),
)
LOCAL = (
    "qwen", "llama", "gemma", "phi", "mistral", "mixtral", "codellama", "codegemma", "deepseek", "starcoder", "yi:", "nomic-",
)
FALLBACK = (1.00, 5.00)

# Weighted complexity patterns by language.
COMPLEXITY = {
    "python": (
        (r"boto3\.client\(\s*['\"]stepfunctions['\"]", 4), (r"boto3\.client\(\s*['\"]eventbridge['\"]", 3),
        (r"boto3\.client\(\s*['\"]kinesis['\"]", 3), (r"boto3\.client\(\s*['\"]sqs['\"]", 2), (r"boto3\.client\(\s*['\"]sns['\"]", 2),
        (r"boto3\.client\(\s*['\"]dynamodb['\"]", 1), (r"boto3\.client\(\s*['\"]s3['\"]", 1),
        (r"(requests|urllib3?|httpx)\.(get|post|put|delete)", 2), (r"import\s+(?:threading|multiprocessing|asyncio)", 2),
        (r"(PAGINATION|paginate|next_token|LastEvaluatedKey)", 2),
    ),
    "node": (
        (r"new\s+SFNClient", 4), (r"new\s+EventBridgeClient", 3), (r"new\s+KinesisClient", 3), (r"new\s+SQSClient", 2),
        (r"new\s+SNSClient", 2), (r"new\s+DynamoDBClient", 1), (r"new\s+S3Client", 1), (r"(axios|fetch|node-fetch|got)\(", 2),
        (r"Promise\.all\(", 2),
    ),
    "java": (
        (r"\bSfnClient\b", 4), (r"\bEventBridgeClient\b", 3), (r"\bKinesisClient\b", 3), (r"\bSqsClient\b", 2), (r"\bSnsClient\b", 2),
        (r"\bDynamoDbClient\b", 1), (r"\bS3Client\b", 1), (r"CompletableFuture\.allOf", 2),
    ),
    "csharp": (
        (r"\bAmazonStepFunctionsClient\b", 4), (r"\bAmazonEventBridgeClient\b", 3), (r"\bAmazonKinesisClient\b", 3),
        (r"\bAmazonSQSClient\b", 2), (r"\bAmazonSimpleNotificationServiceClient\b", 2), (r"\bAmazonDynamoDBClient\b", 1),
        (r"\bAmazonS3Client\b", 1), (r"Task\.WhenAll", 2),
    ),
    "cobol": (
        (r"\bALTER\b", 5), (r"GO\s+TO\s+\w+\s+DEPENDING", 3), (r"PERFORM\s+\w+\s+THRU\s+\w+", 3), (r"EXEC\s+CICS\s+(?:LINK|XCTL)", 3),
        (r"\bSORT\b.*\bUSING\b", 2), (r"COMP-3|PACKED-DECIMAL", 2), (r"REDEFINES", 2), (r"OCCURS.*DEPENDING ON", 2), (r"EXEC\s+SQL", 1),
    ),
}
COMPLEXITY["typescript"] = COMPLEXITY["node"]

# Lines that history compression keeps; lines that start a semantic chunk, and the names on them, by language.
KEY_LINES = (
    r"^\s*(?:import|from|#include|using|require|package)\s",
    r"^\s*(?:class|interface|enum|struct|record|def|function|async|public|private|protected)\s",
    r"""^\s*(?:\"\"\"|'''|//|/\*|\*|#)""",
)
BOUNDARY = {
    "python": r"^(?:class\s+\w|(?:async\s+)?def\s+\w)",
    "node": r"^(?:(?:async\s+)?function\s+\w|class\s+\w|(?:const|let|var)\s+\w+\s*=\s*(?:async\s+)?(?:\(|function))",
    "typescript": (
        r"^(?:(?:export\s+)?(?:async\s+)?function\s+\w|(?:export\s+)?(?:abstract\s+)?class\s+\w"
        r"|(?:export\s+)?(?:const|let|var)\s+\w+\s*(?::\s*\S+)?\s*=\s*(?:async\s+)?(?:\(|function))"
    ),
    "java": (
        r"^\s*(?:public|private|protected|static|abstract|final|\s)*"
        r"(?:class|interface|enum|record|(?:[\w<>\[\],\s]+\s+\w+\s*\())"
    ),
    "csharp": (
        r"^\s*(?:public|private|protected|internal|static|async|sealed|abstract|\s)*"
        r"(?:class|interface|struct|record|enum|(?:[\w<>\[\],\s]+\s+\w+\s*\())"
    ),
    "go": r"^\s*func\s+(?:\(\w+\s+\*?\w+\)\s+)?\w",
}
SYMBOLS = {
    "python": (r"^(?:class|(?:async\s+)?def)\s+(\w+)", 1),
    "typescript": (r"^(?:(?:export\s+)?(?:async\s+)?function\s+(\w+)|class\s+(\w+))", 2),
    "node": (r"^(?:(?:export\s+)?(?:async\s+)?function\s+(\w+)|class\s+(\w+))", 2),
    "java": (r"^\s*(?:public|private|protected|static|\s)*(?:class|interface|enum|record)\s+(\w+)", 1),
    "csharp": (r"^\s*(?:public|private|protected|internal|\s)*(?:class|interface|struct|record)\s+(\w+)", 1),
}

# What the scorers of a migrated unit look for.
SCORED_SDK = r"(?:import\s+boto3|from\s+boto3|@aws-sdk/|software\.amazon\.awssdk|Amazon\.[A-Z]\w+Client)"
SCORED_TARGET = r"from\s+azure\.|import\s+azure\."
SCORED_KEYS = r"(AccessKey|SharedAccessSignature|AZURE_[A-Z]+_KEY\s*=)"
SCORED_IDENTITY = r"DefaultAzureCredential\("
FOREIGN_MARKERS = (r"\bvar\b", r"\blet\b", r"\bpublic\s+class\b", r"\busing\s+System", r"=>\s*\{")

# DD names of plumbing, never business inputs or outputs.
INFRA_DD = ("STEPLIB", "JOBLIB", "SYSLIB", "SYSPROC", "SYSIN", "SYSOUT", "SYSUDUMP", "SYSABEND", "SYSPRINT")

# Shapes and fills of nodes (with what is added), colours and lines of edges in renders.
NODE_SHAPES = {
    "program": ("box", "#cde4ff", "bold"), "section": ("box", "#e8f4ff", None), "paragraph": ("box", "#f7fbff", None),
    "file": ("cylinder", "#ffe0b3", None), "record": ("note", "#fff6e0", None), "field": ("ellipse", "#fffaf0", None),
    "external_call": ("trapezium", "#ffb3b3", None), "txn_call": ("trapezium", "#ffccf2", None),
    "sql_block": ("parallelogram", "#d0f0d0", None), "dataset_ref": ("cylinder", "#fff0b3", "filled"),
    "job": ("tab", "#e0d0ff", "bold"), "step": ("component", "#f0e0ff", None),
}
EDGE_STYLES = {
    "contains": ("#666666", "solid"), "performs": ("#1a7f37", "solid"), "calls": ("#cc0000", "solid"), "step_of": ("#0066cc", "dashed"),
    "reads": ("#1a7f37", "solid"), "writes": ("#cc6600", "solid"), "dd_of": ("#0066cc", "dashed"), "redefines": ("#9a00cc", "dotted"),
    "defined_in": ("#888888", "dotted"), "branches_to": ("#cc0000", "dashed"),
}
UNIT_EDGE_COLOURS = {
    "imports": "#666666", "reads_from": "#1a7f37", "writes_to": "#b35900", "publishes_to": "#9a00cc", "queues_to": "#9a00cc",
    "invokes": "#cc0000", "shares_lib": "#888888",
}
