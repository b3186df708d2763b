"""DataFrame to DataFrame operators over readings, containers and sites."""
