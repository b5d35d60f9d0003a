"""Tool registry: one row of metadata per tool name, plus prefix rules.

The table is fixed size (about 200 rows), so it is always safe to
broadcast. Callers extend it with ``extra`` rows.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

REGISTRY_SCHEMA = (
    "tool string, category string, stage_hint string, equivalence_group string, "
    "operation_type string, comparison_strategy string, context_sensitive boolean"
)
PREFIX_SCHEMA = (
    "rule_order int, prefix string, category string, stage_hint string, "
    "equivalence_group string, operation_type string, comparison_strategy string, "
    "context_sensitive boolean"
)

# Fixed values. Columns: tool, category, fixed stage (- = decided by context
# when the last column says ctx), equivalence group, operation, comparison.
_TOOLS = """
read_file read - file_read read file_path ctx
replace_string_in_file edit - file_edit modify file_path ctx
multi_replace_string_in_file edit - file_edit modify file_path ctx
apply_patch edit - file_edit modify file_path ctx
edit_file edit - file_edit modify file_path ctx
create_file edit - file_edit create file_path ctx
edit_notebook_file edit - notebook_edit modify file_path ctx
delete_file edit - file_delete delete file_path ctx
remove_file edit - file_delete delete file_path ctx
file_search search exploration search search query
grep_search search exploration search search query
semantic_search search exploration search search query
list_dir search exploration explore search file_path
list_code_usages search exploration search search query
get_search_view_results search exploration search search identity
run_in_terminal execute - terminal terminal command ctx
get_terminal_output execute - terminal terminal identity ctx
await_terminal execute - terminal terminal identity ctx
kill_terminal execute orchestration terminal terminal identity
terminal_last_command execute verification terminal terminal identity
terminal_selection execute exploration terminal terminal identity
run_task execute - terminal terminal command ctx
get_errors validation verification diagnostics other identity
test_failure validation verification diagnostics other identity
create_directory edit implementation file_edit create file_path
get_changed_files search verification vcs read identity
create_new_jupyter_notebook edit implementation notebook_edit create identity
copilot_getNotebookSummary read exploration notebook_read read file_path
run_notebook_cell execute - notebook_exec terminal file_path ctx
read_notebook_cell_output read - notebook_read read file_path ctx
configure_notebook general orchestration notebook_config other identity
configure_python_notebook general orchestration notebook_config other identity
configure_non_python_notebook general orchestration notebook_config other identity
notebook_install_packages general orchestration env_config other identity
notebook_list_packages read exploration env_info read identity
restart_notebook_kernel general orchestration notebook_config other identity
configure_python_environment general orchestration env_config other identity
get_python_environment_details read exploration env_info read identity
get_python_executable_details read exploration env_info read identity
install_python_packages general orchestration env_config other identity
mcp_pylance_mcp_s_pylanceDocString read exploration code_analysis read query
mcp_pylance_mcp_s_pylanceDocuments search exploration search search query
mcp_pylance_mcp_s_pylanceFileSyntaxErrors validation verification diagnostics other file_path
mcp_pylance_mcp_s_pylanceImports search exploration code_analysis search identity
mcp_pylance_mcp_s_pylanceInstalledTopLevelModules search exploration env_info search identity
mcp_pylance_mcp_s_pylanceInvokeRefactoring edit implementation file_edit modify file_path
mcp_pylance_mcp_s_pylancePythonEnvironments read exploration env_info read identity
mcp_pylance_mcp_s_pylanceRunCodeSnippet execute - terminal terminal command ctx
mcp_pylance_mcp_s_pylanceSettings read exploration env_info read identity
mcp_pylance_mcp_s_pylanceSyntaxErrors validation verification diagnostics other identity
mcp_pylance_mcp_s_pylanceUpdatePythonEnvironment general orchestration env_config other identity
mcp_pylance_mcp_s_pylanceWorkspaceRoots search exploration explore search identity
mcp_pylance_mcp_s_pylanceWorkspaceUserFiles search exploration explore search identity
mcp_time_get_current_time general orchestration - other identity
mcp_time_convert_time general orchestration - other identity
manage_todo_list general orchestration - other identity
ask_questions general orchestration - other identity
open_simple_browser general verification - other identity
fetch_webpage read exploration - read query
github_repo search exploration search search query
get_vscode_api search exploration search search query
install_extension general orchestration env_config other identity
run_vscode_command execute orchestration - other identity
create_and_run_task execute - terminal terminal command ctx
get_task_output execute - terminal terminal identity ctx
create_new_workspace general orchestration - other identity
get_project_setup_info general orchestration - other identity
switch_agent general orchestration - other identity
runSubagent general orchestration - other identity
renderMermaidDiagram general implementation - other identity
vscode_searchExtensions_internal search exploration search search query
bash execute - terminal terminal command ctx
view read - file_read read file_path ctx
create edit - file_edit create file_path ctx
edit edit - file_edit modify file_path ctx
glob search exploration search search query
grep search exploration search search query
web_fetch read exploration - read query
web_search search exploration - search query
task general orchestration - other none
write_bash execute - terminal terminal command ctx
read_bash execute - terminal terminal identity ctx
stop_bash execute orchestration terminal terminal identity
list_bash execute orchestration terminal terminal identity
report_intent general orchestration - other none
store_memory general orchestration - other none
ask_user general orchestration - other none
sql general orchestration - other none
read_agent general orchestration - other none
list_agents general orchestration - other none
fetch_copilot_cli_documentation read exploration - read identity
skill general orchestration - other none
show_file read - file_read read file_path ctx
Bash execute - terminal terminal command ctx
Read read - file_read read file_path ctx
Write edit - file_edit create file_path ctx
Edit edit - file_edit modify file_path ctx
Glob search exploration search search query
Grep search exploration search search query
Task general orchestration - other none
WebFetch read exploration - read query
WebSearch search exploration - search query
AskUserQuestion general orchestration - other none
NotebookEdit edit - notebook_edit modify file_path ctx
EnterPlanMode general orchestration - other none
ExitPlanMode general orchestration - other none
EnterWorktree general orchestration - other none
TaskOutput general orchestration - other none
TaskStop general orchestration - other none
TaskCreate general orchestration - other none
TaskGet general orchestration - other none
TaskUpdate general orchestration - other none
TaskList general orchestration - other none
Skill general orchestration - other none
Agent general orchestration - other none
request general orchestration - other none
think general orchestration - other none
github-mcp-server-actions_get read exploration github_mcp read identity
github-mcp-server-get_commit read exploration github_mcp read identity
github-mcp-server-issue_read read exploration github_mcp read identity
github-mcp-server-pull_request_read read exploration github_mcp read identity
github-mcp-server-get_copilot_space read exploration github_mcp read identity
github-mcp-server-get_file_contents read exploration github_mcp read file_path
github-mcp-server-get_job_logs read verification github_mcp read identity
github-mcp-server-actions_list search exploration github_mcp search query
github-mcp-server-list_branches search exploration github_mcp search query
github-mcp-server-list_commits search exploration github_mcp search query
github-mcp-server-list_issues search exploration github_mcp search query
github-mcp-server-search_issues search exploration github_mcp search query
github-mcp-server-list_pull_requests search exploration github_mcp search query
github-mcp-server-search_pull_requests search exploration github_mcp search query
github-mcp-server-search_code search exploration github_mcp search query
github-mcp-server-search_repositories search exploration github_mcp search query
github-mcp-server-search_users search exploration github_mcp search query
github-mcp-server-list_copilot_spaces search exploration github_mcp search identity
azure-documentation search exploration azure_mcp search query
azure-get_azure_bestpractices read exploration azure_mcp read identity
azure-azureterraformbestpractices read exploration azure_mcp read identity
azure-bicepschema read exploration azure_mcp read identity
azure-pricing read exploration azure_mcp read identity
azure-marketplace read exploration azure_mcp read identity
azure-workbooks read exploration azure_mcp read identity
azure-quota read exploration azure_mcp read identity
azure-advisor read exploration azure_mcp read identity
azure-deploy execute implementation azure_mcp terminal identity
azure-azd execute implementation azure_mcp terminal identity
azure-extension_cli_generate execute implementation azure_mcp terminal identity
azure-monitor validation verification azure_mcp other identity
azure-applicationinsights validation verification azure_mcp other identity
azure-applens validation verification azure_mcp other identity
azure-resourcehealth validation verification azure_mcp other identity
azure-grafana validation verification azure_mcp other identity
azure-datadog validation verification azure_mcp other identity
azure-loadtesting validation verification azure_mcp other identity
azure-extension_azqr validation verification azure_mcp other identity
azure-cloudarchitect general orchestration azure_mcp other identity
azure-azuremigrate general orchestration azure_mcp other identity
azure-compute general orchestration azure_mcp other identity
azure-aks general orchestration azure_mcp other identity
azure-acr general orchestration azure_mcp other identity
azure-servicefabric general orchestration azure_mcp other identity
azure-virtualdesktop general orchestration azure_mcp other identity
azure-functionapp general orchestration azure_mcp other identity
azure-appservice general orchestration azure_mcp other identity
azure-cosmos general orchestration azure_mcp other identity
azure-sql general orchestration azure_mcp other identity
azure-mysql general orchestration azure_mcp other identity
azure-postgres general orchestration azure_mcp other identity
azure-redis general orchestration azure_mcp other identity
azure-kusto general orchestration azure_mcp other identity
azure-confidentialledger general orchestration azure_mcp other identity
azure-storage general orchestration azure_mcp other identity
azure-fileshares general orchestration azure_mcp other identity
azure-storagesync general orchestration azure_mcp other identity
azure-managedlustre general orchestration azure_mcp other identity
azure-eventgrid general orchestration azure_mcp other identity
azure-eventhubs general orchestration azure_mcp other identity
azure-servicebus general orchestration azure_mcp other identity
azure-signalr general orchestration azure_mcp other identity
azure-communication general orchestration azure_mcp other identity
azure-keyvault general orchestration azure_mcp other identity
azure-policy general orchestration azure_mcp other identity
azure-role general orchestration azure_mcp other identity
azure-search general orchestration azure_mcp other identity
azure-speech general orchestration azure_mcp other identity
azure-foundry general orchestration azure_mcp other identity
azure-appconfig general orchestration azure_mcp other identity
azure-group_list general orchestration azure_mcp other identity
azure-subscription_list general orchestration azure_mcp other identity
azure-extension_cli_install general orchestration azure_mcp other identity
"""

# Fallback rules for unlisted names, tried in this order.
_PREFIXES = """
mcp_pylance_ search exploration - search identity
mcp_time_ general orchestration - other identity
mcp_ general orchestration - other identity
azure- general orchestration - other identity
github-mcp-server- search exploration - search query
"""

#: Up to so many user rows the registry is broadcast; beyond, it is an ordinary join.
BROADCAST_ROWS = 10_000
DEFAULT_ROW = ("general", "orchestration", "", "other", "identity", False)


def _blank(word: str) -> str:
    return "" if word == "-" else word


def registry_rows() -> list[tuple]:
    rows = []
    for line in _TOOLS.strip().splitlines():
        name, cat, stage, group, op, cmp_, *ctx = line.split()
        rows.append((name, cat, _blank(stage), _blank(group), op, cmp_, bool(ctx)))
    return rows


def prefix_rows() -> list[tuple]:
    rows = []
    for i, line in enumerate(_PREFIXES.strip().splitlines()):
        prefix, cat, stage, group, op, cmp_ = line.split()
        rows.append((i, prefix, cat, stage, _blank(group), op, cmp_, False))
    return rows


def tool_registry(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    """Registry table. Rows of ``extra`` replace built-in rows of the same name."""
    base = spark.createDataFrame(registry_rows(), REGISTRY_SCHEMA)
    if extra is None:
        return base
    return base.join(extra.select("tool"), "tool", "left_anti").unionByName(extra)


def tool_prefixes(spark: SparkSession, extra: DataFrame | None = None) -> DataFrame:
    base = spark.createDataFrame(prefix_rows(), PREFIX_SCHEMA)
    return base if extra is None else base.unionByName(extra)


ATTRS = ("category", "stage_hint", "equivalence_group", "operation_type",
         "comparison_strategy", "context_sensitive")


def _descriptor_map() -> Column:
    """The built-in registry as one constant-folded map, so lookup needs no join."""
    table = {name: dict(zip(ATTRS, attrs)) for name, *attrs in registry_rows()}
    return F.from_json(F.lit(json.dumps(table)),
                       "map<string, struct<category: string, stage_hint: string, "
                       "equivalence_group: string, operation_type: string, "
                       "comparison_strategy: string, context_sensitive: boolean>>")


def _descriptor(attrs) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in zip(ATTRS, attrs)])


def with_descriptor(df: DataFrame, tool: str = "tool_used",
                    extra: DataFrame | None = None) -> DataFrame:
    """Attach tool metadata: exact name, else first matching prefix, else default.

    Without ``extra`` this is a projection. With user rows the table is joined; up to
    ``BROADCAST_ROWS`` of them it is broadcast.
    """
    name = F.coalesce(F.col(tool), F.lit(""))
    fallback = _descriptor(DEFAULT_ROW)
    for _, prefix, *attrs in reversed(prefix_rows()):
        fallback = F.when(name.startswith(prefix), _descriptor(attrs)).otherwise(fallback)
    if extra is None:
        found = F.coalesce(F.try_element_at(_descriptor_map(), name), fallback)
        return df.withColumn("_d", found).select(
            *df.columns, *[F.col(f"_d.{a}").alias(a) for a in ATTRS])
    table = tool_registry(df.sparkSession, extra).select(
        F.col("tool").alias("_t"), F.struct(*ATTRS).alias("_d"))
    small = extra.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = df.join(F.broadcast(table) if small else table, name == F.col("_t"), "left")
    return joined.withColumn("_d", F.coalesce("_d", fallback)).select(
        *df.columns, *[F.col(f"_d.{a}").alias(a) for a in ATTRS])


def tools_where(registry: DataFrame, *, category: str | None = None, stage: str | None = None,
                group: str | None = None, context_sensitive: bool | None = None) -> DataFrame:
    """Registry queries: by category, fixed stage, group or context sensitivity."""
    out = registry
    if category is not None:
        out = out.where(F.col("category") == category)
    if stage is not None:
        out = out.where((F.col("stage_hint") == stage) & ~F.col("context_sensitive"))
    if group is not None:
        out = out.where(F.col("equivalence_group") == group)
    if context_sensitive is not None:
        out = out.where(F.col("context_sensitive") == context_sensitive)
    return out.select("tool")


def same_group(group_a: Column, group_b: Column) -> Column:
    return (group_a != "") & (group_a == group_b)
