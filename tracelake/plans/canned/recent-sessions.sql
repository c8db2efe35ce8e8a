SELECT s.session_id, s.project_path, s.first_seen_at, s.last_seen_at,
       count(m.uuid) AS message_count,
       min_by(m.model, CASE WHEN m.model IS NOT NULL THEN struct(m.timestamp, m.uuid) END) AS model
FROM sessions s LEFT JOIN messages m USING (session_id)
GROUP BY ALL
ORDER BY s.last_seen_at DESC, s.session_id
LIMIT :limit
