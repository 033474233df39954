"""PySpark-native analytics for 3D building meshes."""
