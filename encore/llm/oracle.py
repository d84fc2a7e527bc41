"""The same results in SQL, where SQL can say them in reasonable time over whole tables."""

from encore.llm import archives, quality, toolcalls

ORACLE = {
    "op1_zip_archives": archives.SQL,
    "op2_tool_call_linking": toolcalls.SQL,
    "op6_line_rules": quality.SQL,
}
