SELECT t.tool_name, count(*) AS invocations, count_if(coalesce(t.is_error, false)) AS errors
FROM tool_executions t JOIN messages m ON m.uuid = t.message_uuid
WHERE m.session_id = :session_id
GROUP BY t.tool_name
ORDER BY invocations DESC, t.tool_name
