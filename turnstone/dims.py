"""Dimension tables: what each native event of a surface is, in provider-neutral traits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names and order of the enumerations.
PROVIDERS = ("Unknown", "Cursor", "ClaudeCode", "GitHubCopilot")
SURFACES = ("Unknown", "CursorIde", "ClaudeCode", "CopilotCli", "VsCodeAgentHooks")
SOURCE_KINDS = ("Hook", "Sdk", "Synthetic", "Replay", "ProtocolStream", "OpenTelemetry", "CloudApi", "TranscriptFile")
DEFAULT_SURFACE = {"Cursor": "CursorIde", "ClaudeCode": "ClaudeCode", "GitHubCopilot": "CopilotCli"}
EVIDENCE = ("Unavailable", "Ambiguous", "Opaque", "Heuristic", "Derived", "Corroborated", "Observed")

#: Surface: (event, role, scope or "" for by-turn, direction, tone, match strategy, opens).
EVENTS = {
    "CursorIde": (
        ("workspaceOpen", "WorkspaceOpen", "Workspace", "None", "Normal", "None", ""),
        ("sessionStart", "SessionStart", "SessionLifecycle", "None", "Normal", "None", ""),
        ("sessionEnd", "SessionEnd", "SessionLifecycle", "None", "Normal", "None", ""),
        ("beforeSubmitPrompt", "PromptSubmitted", "", "Input", "Normal", "None", ""),
        ("promptTransformed", "PromptTransformed", "", "Input", "Normal", "None", ""),
        ("afterAgentThought", "AgentThought", "", "None", "Thought", "None", ""),
        ("afterAgentResponse", "AgentResponse", "", "Output", "Normal", "None", ""),
        ("preToolUse", "ToolRequest", "", "Input", "Normal", "None", "tool"),
        ("postToolUse", "ToolSuccess", "", "Output", "Normal", "ToolCallId", ""),
        ("postToolUseFailure", "ToolFailure", "", "Output", "Failure", "ToolCallId", ""),
        ("beforeShellExecution", "InnerExecutionStart", "", "Input", "Normal", "ExecutionEvidence", ""),
        ("afterShellExecution", "InnerExecutionEnd", "", "Output", "Normal", "ExecutionEvidence", ""),
        ("beforeMCPExecution", "InnerExecutionStart", "", "Input", "Mcp", "ExecutionEvidence", ""),
        ("afterMCPExecution", "InnerExecutionEnd", "", "Output", "Mcp", "ExecutionEvidence", ""),
        ("beforeReadFile", "FileAccess", "", "Input", "Normal", "FileTarget", ""),
        ("afterFileEdit", "FileAccess", "", "Output", "Normal", "FileTarget", ""),
        ("beforeTabFileRead", "Generic", "Tab", "Input", "Normal", "None", ""),
        ("afterTabFileEdit", "Generic", "Tab", "Output", "Normal", "None", ""),
        ("subagentStart", "SubagentStart", "", "Input", "Normal", "None", "subagent"),
        ("subagentStop", "SubagentStop", "", "Output", "Normal", "Subagent", ""),
        ("preCompact", "CompactionStart", "", "Input", "Compaction", "None", ""),
        ("stop", "TurnStop", "", "Output", "Stop", "None", ""),
    ),
    "ClaudeCode": (
        ("SessionStart", "SessionStart", "SessionLifecycle", "None", "Normal", "None", ""),
        ("Setup", "Generic", "", "None", "Normal", "None", ""),
        ("InstructionsLoaded", "InstructionsLoaded", "", "None", "Normal", "None", ""),
        ("SessionEnd", "SessionEnd", "SessionLifecycle", "None", "Normal", "None", ""),
        ("UserPromptSubmit", "PromptSubmitted", "", "Input", "Normal", "None", ""),
        ("UserPromptExpansion", "PromptTransformed", "", "Input", "Normal", "None", ""),
        ("MessageDisplay", "Message", "", "None", "Normal", "None", ""),
        ("PreToolUse", "ToolRequest", "", "Input", "Normal", "None", "tool"),
        ("PermissionRequest", "PermissionRequest", "", "Input", "Permission", "None", ""),
        ("PostToolUse", "ToolSuccess", "", "Output", "Normal", "ToolCallId", ""),
        ("PostToolUseFailure", "ToolFailure", "", "Output", "Failure", "ToolCallId", ""),
        ("PostToolBatch", "ToolBatch", "", "Output", "Normal", "ToolCallId", ""),
        ("PermissionDenied", "PermissionDenied", "", "Output", "Failure", "ToolCallId", ""),
        ("Notification", "Notification", "", "None", "Normal", "None", ""),
        ("SubagentStart", "SubagentStart", "", "Input", "Normal", "None", "subagent"),
        ("SubagentStop", "SubagentStop", "", "Output", "Normal", "Subagent", ""),
        ("TaskCreated", "TaskCreated", "", "None", "Normal", "None", ""),
        ("TaskCompleted", "TaskCompleted", "", "Output", "Normal", "None", ""),
        ("Stop", "TurnStop", "", "Output", "Stop", "None", ""),
        ("StopFailure", "RuntimeError", "", "Output", "Failure", "None", ""),
        ("TeammateIdle", "Generic", "", "None", "Normal", "None", ""),
        ("ConfigChange", "ConfigChange", "", "None", "Normal", "None", ""),
        ("CwdChanged", "WorkingDirectoryChange", "", "None", "Normal", "None", ""),
        ("DirectoryAdded", "DirectoryChange", "", "None", "Normal", "None", ""),
        ("FileChanged", "Generic", "", "None", "Normal", "None", ""),
        ("WorktreeCreate", "Generic", "", "None", "Normal", "None", ""),
        ("WorktreeRemove", "Generic", "", "None", "Normal", "None", ""),
        ("PreCompact", "CompactionStart", "", "Input", "Compaction", "None", ""),
        ("PostCompact", "CompactionEnd", "", "Output", "Compaction", "None", ""),
        ("Elicitation", "Generic", "", "Input", "Normal", "None", ""),
        ("ElicitationResult", "Generic", "", "Output", "Normal", "None", ""),
        ("PreModelSwitch", "ModelSwitchStart", "", "Input", "Normal", "None", ""),
        ("PostModelSwitch", "ModelSwitchEnd", "", "Output", "Normal", "None", ""),
    ),
    "CopilotCli": (
        ("sessionStart", "SessionStart", "SessionLifecycle", "None", "Normal", "None", ""),
        ("sessionEnd", "SessionEnd", "SessionLifecycle", "None", "Normal", "None", ""),
        ("userPromptSubmitted", "PromptSubmitted", "", "Input", "Normal", "None", ""),
        ("userPromptTransformed", "PromptTransformed", "", "Input", "Normal", "None", ""),
        ("preToolUse", "ToolRequest", "", "Input", "Normal", "None", "tool"),
        ("postToolUse", "ToolSuccess", "", "Output", "Normal", "ToolSignature", ""),
        ("postToolUseFailure", "ToolFailure", "", "Output", "Failure", "ToolSignature", ""),
        ("permissionRequest", "PermissionRequest", "", "Input", "Permission", "PermissionSignature", ""),
        ("notification", "Notification", "", "None", "Normal", "None", ""),
        ("agentStop", "TurnStop", "", "Output", "Stop", "None", ""),
        ("subagentStart", "SubagentStart", "", "Input", "Normal", "None", "subagent"),
        ("subagentStop", "SubagentStop", "", "Output", "Normal", "Subagent", ""),
        ("errorOccurred", "RuntimeError", "", "None", "Failure", "None", ""),
        ("preCompact", "CompactionStart", "", "Input", "Compaction", "None", ""),
    ),
    "VsCodeAgentHooks": (
        ("SessionStart", "SessionStart", "SessionLifecycle", "None", "Normal", "None", ""),
        ("UserPromptSubmit", "PromptSubmitted", "", "Input", "Normal", "None", ""),
        ("PreToolUse", "ToolRequest", "", "Input", "Normal", "None", "tool"),
        ("PostToolUse", "ToolSuccess", "", "Output", "Normal", "ToolCallId", ""),
        ("PreCompact", "CompactionStart", "", "Input", "Compaction", "None", ""),
        ("SubagentStart", "SubagentStart", "", "Input", "Normal", "None", "subagent"),
        ("SubagentStop", "SubagentStop", "", "Output", "Normal", "Subagent", ""),
        ("Stop", "TurnStop", "", "Output", "Stop", "None", ""),
    ),
}
#: The traits of an event, in the order that they have above.
TRAITS = ("role", "scope_override", "direction", "tone", "match_strategy", "opens")


def event_traits(surface: Column, native_event: Column) -> Column:
    """The traits (struct of TRAITS) of a surface's event, null for an unknown one: looked up in a literal map, without a join."""
    entries = [x for of, rows in EVENTS.items() for event, *traits in rows for x in (F.lit(f"{of}\x1f{event}"), F.struct(*[F.lit(t).alias(n) for n, t in zip(TRAITS, traits, strict=True)]))]
    return F.try_element_at(F.create_map(*entries), F.concat(surface, F.lit("\x1f"), native_event))
