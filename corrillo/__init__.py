"""corrillo: a Spark-native analytics engine for exported group chats and text corpora."""
