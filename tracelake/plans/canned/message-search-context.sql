SELECT m.uuid, m.session_id, m.type AS message_type, m.timestamp, c.block_type, substr(c.text_content, 1, 200) AS content_preview
FROM messages m JOIN message_content c ON m.uuid = c.message_uuid
WHERE contains(lower(c.text_content), lower(:search_term))
ORDER BY m.timestamp DESC, m.uuid
LIMIT :limit
